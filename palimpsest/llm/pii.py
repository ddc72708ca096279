"""PII by pattern and by information-theoretic sanitisation.

Patterns find the protected entities: e-mail addresses, IP addresses, payment
cards and phone numbers. The words around each entity are then weighed over the
whole corpus: a term's disclosure of an entity is the share of the term's
documents in which that entity stands near it, and its pointwise mutual
information with the entity. Terms over both thresholds would give the entity
away even when it is masked, so they are sanitised too, wherever they stand in any
text of the corpus: generalised to a placeholder, as entities are, or removed where
their disclosure is REMOVE or more. Terms of fewer than LENGTH characters are not
weighed.

Defined cases: a null text counts as empty; positions are code points, ends
exclusive; patterns match leftmost without overlap for each kind, and a match
that fails its kind's check is dropped without a retry; spans of different kinds
may overlap, and what they cover together is sanitised as the first of them;
repeated rows are scanned one by one but count as separate documents
in the statistics; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, free_name, materialize
from palimpsest.llm.decontam import _probe, _table

# The patterns. Possessive repeats and the look-behinds change no match: they only
# keep long runs of one class from being tried again from each of their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words looked at on each side of an entity, and characters read to get them.
REACH, SIDE = 6, 120
#: A term is sanitised if its disclosure is at least so much, at so many documents.
DISCLOSURE, PMI, SUPPORT = 0.5, 3.0, 2
#: From this disclosure on a term is removed instead of generalised.
REMOVE = 0.9
#: Least characters of a term that is weighed.
LENGTH = 4


def _luhn(digits: Column) -> Column:
    """The digits, read from the right, pass the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 1, (d := F.substring(digits, i, F.lit(1)).cast("int")) * 2 - F.when(d >= 5, F.lit(9)).otherwise(F.lit(0))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    return F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)) if kind == "card" else n.between(10, 15)


def _running(values: Column, start: Column, add, chunk: int = 64) -> Column:
    """For each of an array variable's values, what add makes of all before it.

    add must not care how its values are grouped. Two levels of chunks, as a fold
    that grows one long array would copy it for each value.
    """
    none = F.expr("cast(array() as array<int>)")
    fold = lambda xs, first: F.aggregate(xs, F.struct(first.alias("at"), none.alias("out")), lambda acc, x: F.struct(add(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
    begins = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(chunk))
    parts = F.transform(begins, lambda i: F.slice(values, i, chunk))
    wholes = F.transform(parts, lambda p: F.aggregate(p, start, add))
    return _let(F.struct(parts.alias("parts"), fold(wholes, start).alias("firsts")), lambda x: F.flatten(F.zip_with(x.parts, x.firsts, fold)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, rank, end, value>> of one kind's valid matches.

    The pieces between matches and the matches alternate, so that their lengths
    add up to each match's start.
    """
    pattern = PATTERNS[kind]
    rank = KINDS.index(kind)
    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("g"))
    both = lambda x: F.struct(x.v.alias("v"), x.g.alias("g"), F.zip_with(x.v, F.slice(x.g, F.lit(1), F.size(x.v)), lambda v, g: F.length(v) + g).alias("n"))
    span = lambda v, i, x, before: F.struct((F.get(before, i) + F.get(x.g, i)).alias("start"), F.lit(rank).alias("rank"), (F.get(before, i) + F.get(x.g, i) + F.length(v)).alias("end"), v.alias("value"))
    found = _let(_let(pieces, both), lambda x: _let(_running(x.n, F.lit(0), lambda a, y: a + y), lambda before: F.transform(x.v, lambda v, i: span(v, i, x, before))))
    full = F.filter(found, lambda s: _valid(kind, s.value))
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][0-9 -]")}[kind]
    return F.when(hint, full).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)"))


def entities(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, key (its digest), base (the valid matches of all kinds with their
    context) and clean (the text with the matches masked, if there are any)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in KINDS])).alias("base"))
    near = lambda s: F.struct(
        s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"), s.value.alias("value"),
        F.substring("text", F.greatest(s.start - SIDE, F.lit(0)) + 1, F.least(s.start, F.lit(SIDE))).alias("before"),
        F.substring("text", s.end + 1, F.lit(SIDE)).alias("after"),
    )
    spans = F.transform("base", lambda x: F.struct(x.start.alias("start"), x.rank.alias("rank"), x.end.alias("end"), F.lit(False).alias("removed")))
    clean = F.when(F.size("base") > 0, masked(F.col("text"), spans))
    return found.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("key"), F.transform("base", near).alias("base"), clean.alias("clean")).withColumn("row", F.monotonically_increasing_id())


_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"  # of a term: an ASCII letter or any other character
_TERM = rf"{_LETTER}+"


def _terms(side: Column, base: Column, before: bool, length: int = LENGTH) -> Column:
    """The words of a context with their places; a word cut by its edge is left out."""
    gaps = F.transform(F.split(side, _TERM, -1), lambda x: F.length(x))
    value = F.regexp_extract_all(side, F.lit(_TERM), F.lit(0))
    folded = F.aggregate(
        F.arrays_zip(value.alias("v"), F.slice(gaps, 1, F.size(value)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,term:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc.at + x.g + F.length(x.v)).alias("at"),
            F.concat(acc.out, F.array(F.struct((acc.at + x.g).alias("start"), (acc.at + x.g + F.length(x.v)).alias("end"), ascii_lower(x.v).alias("term")))).alias("out"),
        ),
        lambda acc: acc.out,
    )
    n = F.length(side)
    whole = F.filter(folded, lambda t: (F.length(t.term) >= length) & ((t.start > 0) | F.lit(not before) | (n < SIDE)) & ((t.end < n) | F.lit(before) | (n < SIDE)))
    reach = F.slice(whole, F.greatest(F.size(whole) - REACH + 1, F.lit(1)), REACH) if before else F.slice(whole, 1, REACH)
    shift = base.start - n if before else base.end
    return F.transform(reach, lambda t: F.struct((t.start + shift).alias("start"), (t.end + shift).alias("end"), t.term.alias("term")))


def _everywhere(rows: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, start, end, term, removed of all places of the terms; row and text of their texts).

    A word that runs into an entity is left out: masking it would cut the entity.
    """
    bits = _table(terms.select(F.xxhash64("term").alias("g")))
    word = F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))
    maybe = F.filter(F.transform(word, lambda x, i: F.struct(i.alias("i"), ascii_lower(x).alias("term"))), lambda x: _probe(F.xxhash64(x.term), bits))
    base = F.transform("base", lambda b: b.start)
    held = materialize(rows.select("row", "text", "base", base.alias("starts"), maybe.alias("maybe")).where(F.size("maybe") > 0), "holders")
    # A word starts after the words before it and the gaps up to it.
    gaps = F.transform(F.split("text", _TERM, -1), lambda x: F.length(x))
    sizes = held.select("row", "starts", "maybe", gaps.alias("gaps"), F.zip_with(F.transform(word, lambda x: F.length(x)), F.slice(gaps, F.lit(1), F.size(word)), lambda w, g: w + g).alias("n"))
    before = lambda use: _let(_running(F.col("n"), F.lit(0), lambda a, y: a + y), use)
    start = before(lambda b: F.transform("maybe", lambda x: F.struct((F.get(b, x.i) + F.get("gaps", x.i)).alias("start"), x.term.alias("term"))))
    found = sizes.select("row", "starts", F.inline(start)).withColumn("end", F.col("start") + F.length("term"))
    cuts = F.exists("starts", lambda b: (b > F.col("start")) & (b < F.col("end")))
    return found.where(~cuts).select("row", "start", "end", "term").join(terms, "term").select("row", "start", "end", "term", "removed"), held


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, pmi: float = PMI, support: int = SUPPORT, length: int = LENGTH, remove: float = REMOVE) -> DataFrame:
    """row, doc_id, base, terms (spans of words that give an entity away) and clean.

    clean is the sanitised text, or null where nothing was found.
    """
    rows = materialize(entities(docs), "entities")
    near = rows.where(F.size("base") > 0).select("row", F.explode("base").alias("b")).select(
        "row", "b.rank", "b.value",
        F.inline(F.concat(_terms(F.col("b.before"), F.col("b"), True, length), _terms(F.col("b.after"), F.col("b"), False, length))),
    )
    near = materialize(near, "contexts")
    # Documents in which a term stands near an entity, and in which the entity is.
    pairs = near.select("row", "rank", "value", "term").distinct().groupBy("rank", "value", "term").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= support)
    pairs = materialize(pairs, "pairs")
    owners = rows.select("row", F.explode("base").alias("b")).select("row", "b.rank", "b.value").distinct().groupBy("rank", "value").agg(F.count(F.lit(1)).alias("n_entity"))
    # Document counts of all terms of the corpus, combined before the shuffle. No
    # semi-join here: it would go below the aggregate and shuffle every occurrence.
    bag = F.array_distinct(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"))
    counts = rows.select(F.explode(bag).alias("term")).where(F.length("term") >= length).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = F.lit(max(1, rows.count()))
    weighed = (
        pairs.join(counts, "term")
        .join(owners, ["rank", "value"])
        .withColumn("disclosure", F.col("n_pair") / F.greatest("n_term", "n_pair"))
        .withColumn("pmi", F.log2(F.col("n_pair") * total / (F.greatest("n_term", "n_pair") * F.col("n_entity"))))
    )
    telling = materialize(weighed.where((F.col("disclosure") >= disclosure) & (F.col("pmi") >= pmi)).select("rank", "value", "term", "disclosure"), "telling")
    terms = materialize(telling.groupBy("term").agg((F.max("disclosure") >= remove).alias("removed")), "terms")
    beside = near.join(telling, ["rank", "value", "term"], "left_semi").join(terms, "term").select("row", "start", "end", "term", "removed")
    found, holders = _everywhere(rows, terms)
    places = beside.unionByName(found)
    of = materialize(places.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "term", "removed"))).alias("terms")), "places")
    # Only texts with terms are joined; entities alone are masked where they were found.
    span = lambda x, rank, removed: F.struct(x.start.alias("start"), rank.alias("rank"), x.end.alias("end"), removed.alias("removed"))
    spans = F.array_sort(F.concat(F.transform("base", lambda x: span(x, x.rank, F.lit(False))), F.transform("terms", lambda x: span(x, F.lit(len(KINDS)), x.removed))))
    cleaned = holders.select("row", "text", "base").join(of, "row").select("row", "terms", masked(F.col("text"), spans).alias("with_terms"))
    return rows.drop("text").join(cleaned, "row", "left").withColumn("clean", F.coalesce("with_terms", "clean")).drop("with_terms")


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with sanitised texts; a text in which nothing was found stays as it is, null included."""
    name, key, own = free_name(docs, "clean_text", "clean_key", "own_key")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    new = sanitise(docs, **thresholds).where(F.col("clean").isNotNull()).select(F.col("key").alias(key), F.col("clean").alias(name))
    # Equal texts are sanitised alike.
    new = materialize(new.dropDuplicates([key]), "sanitised")
    joined = docs.withColumn(own, digest).join(new.hint("merge"), F.col(own) == F.col(key), "left")
    return joined.withColumn("text", F.coalesce(F.col(name), F.col("text"))).select(docs.columns)


def _key(parts: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", F.get(kind, s.rank), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts, spans and a digest of the sanitised text (null if it is as it was) for each document."""
    rows = sanitise(docs, length=length)
    plain = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end")))
    extra = F.transform(F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,end:int,term:string,removed:boolean>>)")), lambda t: F.struct(t.start.alias("start"), F.lit(len(KINDS)).alias("rank"), t.end.alias("end")))
    count = lambda i: F.size(F.filter("base", lambda s: s.rank == i)).cast("long").alias(f"n_{KINDS[i]}")
    return rows.select(
        "doc_id",
        *[count(i) for i in range(len(KINDS))],
        F.sha2(_key(plain).cast("binary"), 256).alias("base_sha256"),
        _key(F.array_sort(F.concat(plain, extra))).alias("spans"),
        F.md5(F.col("clean").cast("binary")).alias("clean_md5"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span generalised to a placeholder of its kind, or removed.

    spans: array<struct<start, rank, end, removed>> sorted by start; what overlapping
    spans cover together becomes one placeholder, that of the first.
    """
    kind = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    sign = lambda s: F.when(s.removed, F.lit("")).otherwise(F.concat(F.lit("<"), F.get(kind, s.rank), F.lit(">")))

    def piece(s: Column, end: Column) -> Column:
        """The text since all spans before, and the placeholder."""
        return F.when(s.start < end, F.lit("")).otherwise(F.concat(F.substring(text, end + 1, s.start - end), sign(s)))

    def joined(x: Column) -> Column:
        ends = _let(F.transform(x, lambda s: s.end), lambda e: _running(e, F.lit(0), lambda a, y: F.greatest(a, y)))
        pieces = _let(ends, lambda e: F.transform(x, lambda s, i: piece(s, F.get(e, i))))
        last = F.coalesce(F.array_max(F.transform(x, lambda s: s.end)), F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    return _let(spans, joined)
