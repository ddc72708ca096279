"""Benchmark decontamination by template canonicalisation.

Numbers (with their decimals), names (of one or several words) and units after a
number become typed placeholders, so that a question with other numbers keeps its
template. Rolling windows of template words are hash-joined to those of the
benchmark; windows of placeholders alone are left out, as any run of numbers would
match them. Hits of an item are gathered by diagonal (place in the text less place in
the item); diagonals near each other belong to one place. There the values in the
placeholders are checked: one value of the item must always correspond to one value
of the document, and the other way round. Diagonals are added to a place, the
largest first, as long as all its slots stay consistent. A verbatim copy passes
trivially, a re-parameterised question does if its slots are consistent, and chance
matches of templates, scattered or not, do not.

Names are told by their capital, which a copy in other letters or with other
punctuation may lack. So windows are joined in a second form too, in which names
stand for themselves as lowered words; the form that covers more of the item counts.

Defined cases: a null text counts as empty; items with fewer words than a window
can't be told from ordinary prose and never match (WINDOW is a parameter), nor do
items of placeholders alone; items
with equal texts are matched alike; repeated rows are judged one by one; an empty
benchmark leaves everything clean; extra columns pass through decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import GAP, free_name, materialize

WINDOW, COVERAGE = 5, 0.8
#: Words by which neighbouring diagonals of a place may differ. All of a place differ from
#: its largest one by as many, or by a share of the item's windows.
DRIFT, DRIFT_SHARE = 8, 0.25
# Units of measure that become a placeholder after a number.
UNITS = ["km", "kg", "cm", "mm", "ml", "mg", "mph", "kwh", "hz", "khz", "mhz", "ghz", "usd", "eur", "gbp", "meters", "metres", "miles", "feet", "inches", "hours", "minutes", "seconds", "days", "dollars", "euros", "cents", "percent", "grams", "kilograms", "liters", "litres", "pounds", "degrees"]
#: Private-use characters, which lower() leaves: before a name, inside a decimal number,
#: between the words of a name, before a unit.
_NAME, _POINT, _AND, _UNIT = "\ue000", "\ue001", "\ue002", "\ue003"
#: The benchmark's windows are broadcast up to this many, else shuffled.
BROADCAST_ROWS = 200_000
_BITS = 1 << 18


def _plain(text: Column) -> Column:
    """The text with decimals joined and units after numbers marked."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), "[.,](?<=[0-9][.,])(?=[0-9])", _POINT)
    return F.regexp_replace(joined, rf"([0-9]\s++)(?=(?i:{'|'.join(UNITS)})(?![\p{{L}}0-9]))", f"$1{_UNIT}")


def _slots(plain: Column, names: bool = True) -> Column:
    """The lowered words of _plain(), names marked if wanted, aligned with the template's words."""
    if names:
        marked = F.regexp_replace(plain, r"([a-z0-9,;]\s++)(?=\p{Lu}\p{Ll})", f"$1{_NAME}")
        plain = F.replace(F.regexp_replace(marked, rf"({_NAME}\p{{L}}++)\s++(?={_NAME})", f"$1{_AND}"), F.lit(_AND + _NAME), F.lit(_AND))
    return F.filter(F.split(F.lower(plain), GAP), lambda w: w != "")


def _kind(w: Column) -> Column:
    """The placeholder of a word, or null if the word stands for itself."""
    special = F.when(w < ":", F.lit("<number>")).when(w.startswith(_NAME), F.lit("<name>")).when(w.startswith(_UNIT), F.lit("<unit>"))
    return F.when((w < ":") | (w >= _NAME), special)


def _hashed(df: DataFrame, k: int) -> DataFrame:
    """Adds words and window hashes, one for each start, in both forms: w, g and v, p."""
    df = df.withColumn("plain", _plain(F.col("text")))
    df = df.withColumn("w", _slots(F.col("plain"))).withColumn("v", _slots(F.col("plain"), names=False))
    return _rolled(_rolled(df, "w", "g", k), "v", "p", k)


def _rolled(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Adds the window hashes of an array of words."""
    df = df.withColumn(f"{out}h1", F.transform(words, lambda x: F.xxhash64(F.coalesce(_kind(x), x))))
    n, cur = 1, f"{out}h1"
    while n * 2 <= k:
        df = df.withColumn(f"{out}h{n * 2}", _joined(cur, cur, n))
        n, cur = n * 2, f"{out}h{n * 2}"
    have = n
    while have < k:  # fill up with the largest power of two that fits
        p = 1 << ((k - have).bit_length() - 1)
        df = df.withColumn(f"{out}g{have + p}", _joined(cur, f"{out}h{p}", have))
        have, cur = have + p, f"{out}g{have + p}"
    return df.withColumn(out, F.col(cur))


def _joined(a: str, b: str, n: int) -> Column:
    """Of two arrays of hashes by start: those of a, each joined to b's n words on."""
    size = F.size(b) - n
    left = F.slice(F.col(a), F.lit(1), F.greatest(size, F.lit(0)))
    right = F.slice(F.col(b), F.lit(n + 1), F.greatest(size, F.lit(0)))
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def _probe(h: Column, bits: Column) -> Column:
    """Two bits of h are set in the table."""
    one = F.shiftrightunsigned(h, 46).cast("int")  # 18 bits
    two = h.bitwiseAND(_BITS - 1).cast("int")
    bit = lambda x: F.getbit(F.get(bits, F.shiftright(x, 6)), x.bitwiseAND(63)) == 1
    return bit(one) & bit(two)


def _table(windows: DataFrame) -> Column:
    """The bits of all windows' hashes, as a literal of a fixed 32 KB.

    More windows fill it up, which lets more rows through to the join but
    changes no result.
    """
    at = F.explode(F.array(F.shiftrightunsigned("g", 46).cast("int"), F.col("g").bitwiseAND(_BITS - 1).cast("int")))
    rows = (
        windows.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
        .collect()  # _BITS / 64 rows at most
    )
    table = [0] * (_BITS // 64)
    for slot, bits in rows:
        table[slot] = bits
    return F.from_json(F.lit(str(table)), "array<bigint>")


def _one_to_one(slots: Column) -> Column:
    """No value of the item stands for two of the document, nor the other way round."""
    values = lambda of: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s.kind, s[of]))))
    return (values("item") == F.size(slots)) & (values("doc") == F.size(slots))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows has doc_id, row, key; found has row, item_id, coverage.

    key is a digest of the text, by which equal texts can be found again.
    """
    items = materialize(_hashed(benchmark.select("item_id", "text"), k).select("item_id", "w", "g", "v", "p"), "items")

    def of(form: int, w: str, g: str) -> DataFrame:
        each = F.transform(g, lambda h, i: F.struct(i.alias("ipos"), h.alias("g"), F.slice(F.col(w), i + 1, k).alias("iwords")))
        told = F.filter(each, lambda x: F.exists(x.iwords, lambda y: _kind(y).isNull()))
        return items.select("item_id", F.lit(form).alias("form"), told.alias("told")).select("item_id", "form", F.size("told").alias("n_windows"), F.inline("told"))

    windows = materialize(of(1, "w", "g").unionByName(of(2, "v", "p")), "windows")
    bits = _table(windows)

    def near(form: int, w: str, g: str) -> Column:
        found = F.filter(F.transform(g, lambda h, i: F.struct(i.alias("pos"), h.alias("g"))), lambda x: _probe(x.g, bits))
        return F.transform(found, lambda x: F.struct(F.lit(form).alias("form"), x.pos.alias("pos"), x.g.alias("g"), F.slice(F.col(w), x.pos + 1, k).alias("words")))

    rows = _hashed(docs.select("doc_id", "text"), k).select(
        "doc_id",
        F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"),
        F.concat(near(1, "w", "g"), near(2, "v", "p")).alias("near"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "near")
    side = windows
    if windows.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    hits = rows.where(F.size("near") > 0).select("row", F.inline("near")).join(side, ["form", "g"])
    # Exact check of the templates, as hashes may collide.
    same = F.forall(F.zip_with("words", "iwords", lambda a, b: F.coalesce(_kind(a), a) == F.coalesce(_kind(b), b)), lambda x: x)
    hits = hits.where(same).withColumn("diag", F.col("pos") - F.col("ipos"))
    # Placeholder values along a diagonal, item to document.
    slots = F.filter(
        F.zip_with("iwords", "words", lambda a, b: F.struct(_kind(a).alias("kind"), a.alias("item"), b.alias("doc"))),
        lambda s: s.kind.isNotNull(),
    )
    places = (
        hits.groupBy("row", "item_id", "n_windows", "form", "diag")
        .agg(F.collect_set("ipos").alias("found"), F.array_distinct(F.flatten(F.collect_list(slots))).alias("slots"))
    )
    # A word put in or left out moves the rest to another diagonal of the place.
    at = W.partitionBy("row", "item_id", "n_windows", "form")
    places = (
        places.where(_one_to_one(F.col("slots")))
        .withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(at.orderBy("diag")) > DRIFT).cast("int"), F.lit(1)))
        .withColumn("place", F.sum("new").over(at.orderBy("diag")))
        .groupBy("row", "item_id", "n_windows", "form", "place")
        .agg(F.sort_array(F.collect_list(F.struct(F.size("found").alias("n"), "diag", "found", "slots")), asc=False).alias("diags"))
        .where(F.size(F.array_distinct(F.flatten("diags.found"))) >= coverage * F.col("n_windows"))
    )
    limit = F.greatest(F.lit(DRIFT), F.col("n_windows") * DRIFT_SHARE)
    first = F.get("diags", F.lit(0))

    def add(acc: Column, d: Column) -> Column:
        slots = F.array_union(acc.slots, d.slots)
        new = F.struct(F.array_union(acc.found, d.found).alias("found"), slots.alias("slots"))
        return F.when((F.abs(d.diag - first.diag) <= limit) & _one_to_one(slots), new).otherwise(acc)

    n = F.aggregate("diags", F.struct(first.found.alias("found"), first.slots.alias("slots")), add, lambda acc: F.size(acc.found))
    found = (
        places.select("row", "item_id", (n / F.col("n_windows")).alias("coverage"))
        .groupBy("row", "item_id")
        .agg(F.max("coverage").alias("coverage"))
        .where(F.col("coverage") >= coverage)
    )
    return rows.select("doc_id", "row", "key"), found


def report(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document: doc_id, contaminated, item_ids, coverage."""
    rows, found = matches(docs, benchmark, k, coverage)
    of = found.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("item_ids"), F.max("coverage").alias("coverage"))
    return rows.join(of, "row", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    rows, found = matches(docs, benchmark, k, coverage)
    (key,) = free_name(docs, "text_key")
    bad = materialize(rows.join(found.select("row").distinct(), "row", "left_semi").select(F.col("key").alias(key)).distinct(), "bad")
    tagged = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return tagged.join(bad, key, "left_anti").select(docs.columns)
