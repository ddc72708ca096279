"""Removal of repeated passages by suffix arrays.

Every byte that a LENGTH-byte string covers which also starts anywhere else is
removed. The steps:

1. Equal texts are collapsed; a text of LENGTH bytes or more that has a copy is
   removed whole.
2. Winnowing leaves out what can't repeat: each window of LENGTH bytes has an
   anchor, the GRAM bytes in it with the smallest hash. A run is a series of windows
   with one anchor. Equal windows have equal anchors, so that only runs whose anchor
   occurs twice are looked at.
3. Equal runs are collapsed: what occurs as a whole run elsewhere is a repeat, and
   one of them stands for all. Where an anchor has one run only, no more is needed.
4. The other runs' bytes are gathered into shards of about SHARD bytes. Each gets
   its suffix array by Larsson-Sadakane refinement (groups of equal prefixes are
   sorted by the ranks h bytes on, h doubling, until none is left), and common
   prefixes by Kasai's scan. Neighbours that share LENGTH bytes are repeats.
5. Each shard hands over its sorted 96-bit digests of one window of each group,
   cut into ranges of digests. The shards' parts of a range are merged by binary
   search; a digest of two shards is a repeat in both.

A range holds a digest once for each shard, so that no passage, however often it
occurs, makes a range large. Parts are never more than digests, so that their number
grows with the input.

Defined cases: a null text counts as empty; texts are UTF-8 bytes and repeats may
cut characters; removed runs are judged on the input; equal texts are treated alike
and repeated rows each get a row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import vec
from palimpsest.llm.common import discard, materialize

LENGTH, GRAM = 200, 75
SHARD = 1 << 20
#: Windows that a merge of one range should hold.
RANGE_ROWS = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, the runs of windows with one anchor: spans, the anchors' and the bytes' hashes.

    A span is the first window's start << 32 | the last one's + 1.
    """
    b = vec.Block(texts)
    n = len(b.raw)
    none = (np.zeros(0, np.int64),) * 3
    if n < length:
        return [none] * b.n
    sums = vec.prefix(b.raw)
    h = vec.mix((sums[gram:] - sums[:-gram]) * vec.powers(n + 1)[1][: n - gram + 1])
    w = length - gram + 1
    padded = np.concatenate([h, np.full(-len(h) % w, _NONE)]).reshape(-1, w)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    q = n - length + 1
    low = np.minimum(tail[:q], head[w - 1 : w - 1 + q])
    # Windows that lie in one text.
    step = np.zeros(n + 1, dtype=np.int8)
    long = b.sizes >= length
    np.add.at(step, b.starts[long], 1)
    np.add.at(step, b.ends[long] - length + 1, -1)
    valid = np.cumsum(step[:q], dtype=np.int8) > 0
    # A run ends where the anchor changes, or drops out at the window's left edge.
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (h[: q - 1] == low[:-1])
    at = np.flatnonzero(first)
    own = b.owner(at)
    cut = np.searchsorted(own, np.arange(b.n + 1))
    last = np.minimum(np.append(at[1:], n), b.ends[own] - length + 1)
    last = np.where(np.append(own[1:], -1) == own, last, b.ends[own] - length + 1)
    span = ((at - b.starts[own]) << 32) | (last - b.starts[own])
    whole = vec.span_hash_of(_grams(b.raw), at, last + length - 8).view(np.int64)
    hashes = low[at].view(np.int64)
    return [(span[x:y], hashes[x:y], whole[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _grams(buf: np.ndarray) -> np.ndarray:
    """A scrambled number for the eight bytes from each position on.

    Sums of these tell texts apart that sums of single bytes don't, such as the
    Thue-Morse text and its complement.
    """
    return vec.mix(_eight(buf))


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """All suffixes in order; Kasai's scan needs the order of ties, too."""
    n = len(buf)
    key = _eight(buf)
    order = np.argsort(key, kind="stable")
    s = key[order]
    begins = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    h = 8
    while h < n:
        # Only groups of several suffixes are sorted on.
        group = ~begins
        group[:-1] |= ~begins[1:]
        at = np.flatnonzero(group)
        if not len(at):
            break
        sub = order[at]
        r1, r2 = rank[sub], rank[np.minimum(sub + h, n)]
        by = np.argsort(r1 * (n + 1) + r2 + 1, kind="stable")
        sub, r1, r2 = sub[by], r1[by], r2[by]
        order[at] = sub
        new = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
        begins[at] = new
        rank[sub] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    return order


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros after the end."""
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | wide[i : i + len(buf)]
    return out


def common_prefixes(buf: np.ndarray, order: np.ndarray, cap: int = LENGTH, lane: int = 256) -> np.ndarray:
    """Kasai's scan: bytes that each suffix of the array shares with the one before, up to cap.

    The text is cut into lanes that scan abreast, each from its own start; a lane
    goes on with one byte less than it had, as in the plain scan.
    """
    n = len(buf)
    eight = np.concatenate([_eight(buf), np.zeros(cap + 16, np.uint64)])
    prev = np.full(n, -1, dtype=np.int64)
    prev[order[1:]] = order[:-1]
    plcp = np.zeros(n, dtype=np.int64)
    i = np.arange(0, n, lane)
    stop = np.minimum(i + lane, n)
    h = np.zeros(len(i), dtype=np.int64)
    while len(i):
        p = prev[i]
        x = eight[i + h] ^ eight[np.maximum(p, 0) + h]
        # Bytes alike among the next eight: the highest set bit tells the first that differs.
        same = np.full(len(i), 8, dtype=np.int64)
        odd = x != 0
        same[odd] = 7 - (np.frexp((x[odd] & ~(x[odd] >> np.uint64(1))).astype(np.float64))[1] - 1) // 8
        room = n - np.maximum(i, p) - h  # bytes before the end of the text
        h = np.where(p < 0, 0, np.minimum(h + np.minimum(same, np.maximum(room, 0)), cap))
        done = (same < 8) | (h >= cap) | (p < 0) | (room <= 8)
        at = i[done]
        plcp[at] = h[done]
        i = i + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        go = i < stop
        if not go.all():
            i, h, stop = i[go], h[go], stop[go]
    return plcp[order]


def _digests(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window."""
    grams = _grams(buf)
    big = vec.span_hash_of(grams, at, at + length - 7)
    small = vec.span_hash_of(vec.mix(grams + np.uint64(1)), at, at + length - 7)
    return big, (small >> np.uint64(32)).astype(np.uint32)


def shard_repeats(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of segments, repeated window starts, handed starts, their digests).

    Starts are places in the shard; those handed over are sorted by digest.
    """
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    buf = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8)
    valid = np.zeros(len(buf) + 1, dtype=np.int64)
    np.add.at(valid, offsets, 1)
    np.add.at(valid, offsets + sizes - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    order = suffix_array(buf)
    lcp = common_prefixes(buf, order, length)
    as_before = (lcp >= length) & valid[order]
    as_before[0] = False
    with_next = np.append(as_before[1:], False)
    repeated = order[as_before | with_next]
    # One of each group: the first of its run.
    hand = order[valid[order] & ~as_before]
    big, small = _digests(buf, hand, length)
    by = np.argsort(big, kind="stable")
    return offsets, np.sort(repeated), hand[by], big[by], small[by]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Digests that are in several of the sorted parts, by pairwise binary search."""
    level = [(b, s, np.zeros(len(b), bool)) for b, s in parts]
    while len(level) > 1:
        up = []
        for k in range(0, len(level) - 1, 2):
            (a, sa, ra), (b, sb, rb) = sorted(level[k : k + 2], key=lambda x: -len(x[0]))
            at = np.searchsorted(a, b)
            near = np.minimum(at, max(0, len(a) - 1))
            hit = (a[near] == b) & (sa[near] == sb) if len(a) else np.zeros(len(b), bool)
            ra[near[hit]] = True
            new = ~hit
            up.append((np.insert(a, at[new], b[new]), np.insert(sa, at[new], sb[new]), np.insert(ra, at[new], rb[new])))
        if len(level) % 2:
            up.append(level[-1])
        level = up
    big, small, seen = level[0]
    return big[seen], small[seen]


def _runs(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as pairs (first, last + 1) of runs."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.diff(starts) > 1)
    return np.column_stack([starts[np.concatenate([[0], new + 1])], starts[np.concatenate([new, [len(starts) - 1]])] + 1])


def _pieces(ranges: np.ndarray, length: int, most: int) -> list[tuple[int, int]]:
    """Window ranges merged where their bytes meet, then cut to at most most windows."""
    out: list[list[int]] = []
    for a, e in ranges.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(x, min(x + most, e)) for a, e in out for x in range(a, e, most)]


def _shards(texts: DataFrame, ranges: int, length: int, size: int) -> DataFrame:
    """kind 0: repeats found in a shard; kind 1: digests of a range; kind 2: a shard's layout.

    Kinds 0 and 2 have negative ranges, spread over as many groups as there are ranges.
    """
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else None

    def one(held: list[tuple[int, int, bytes]]) -> Iterator[dict]:
        name = hashlib.sha1(repr([(r, s) for r, s, _ in held]).encode()).hexdigest()
        offsets, repeated, hand, big, small = shard_repeats([x for _, _, x in held], length)
        rest = -1 - int(name[:8], 16) % ranges
        yield {"kind": 2, "shard": name, "rng": rest, "a": offsets.tobytes(), "b": np.array([r for r, _, _ in held], np.int64).tobytes(), "c": np.array([s for _, s, _ in held], np.int64).tobytes()}
        yield {"kind": 0, "shard": name, "rng": rest, "a": repeated.astype(np.int32).tobytes(), "b": b"", "c": b""}
        at = (big >> shift).astype(np.int64) if shift is not None else np.zeros(len(big), np.int64)
        cut = np.searchsorted(at, np.arange(ranges + 1))
        for k in range(ranges):
            if cut[k] < cut[k + 1]:
                x = slice(cut[k], cut[k + 1])
                yield {"kind": 1, "shard": name, "rng": k, "a": big[x].tobytes(), "b": small[x].tobytes(), "c": hand[x].astype(np.int32).tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, bytes]] = []
        total = 0
        for pdf in batches:
            for row, text, found in zip(pdf["row"], pdf["text"], pdf["ranges"], strict=True):
                data = vec.encode(text)
                for a, e in _pieces(_pairs(found), length, size):
                    held.append((row, a, data[a : e + length - 1]))
                    total += e + length - a
                    if total >= size:
                        yield pd.DataFrame(list(one(held)))
                        held, total = [], 0
        if held:
            yield pd.DataFrame(list(one(held)))

    return texts.mapInPandas(run, "kind int, shard string, rng long, a binary, b binary, c binary")


def _merge_ranges(shards: DataFrame) -> DataFrame:
    """kind 0: (shard, a) starts that are repeats in the shard or in another one; kind 2: layouts, as they are.

    The digests are shuffled once, straight from the shards.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="rng")
        if pdf["kind"].iloc[0] != 1:
            return pdf
        parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
        big, small = merged(parts)
        out = []
        for shard, (x, s), c in zip(pdf["shard"], parts, pdf["c"], strict=True):
            if len(big):
                near = np.minimum(np.searchsorted(big, x), len(big) - 1)
                hit = (big[near] == x) & (small[near] == s)
                if hit.any():
                    out.append((0, shard, np.frombuffer(c, np.int32)[hit].tobytes(), b"", b""))
        return pd.DataFrame(out, columns=["kind", "shard", "a", "b", "c"])

    return materialize(shards.groupBy("rng").applyInPandas(merge, "kind int, shard string, a binary, b binary, c binary"), "merged")


def _pairs(spans: np.ndarray) -> np.ndarray:
    """Spans (first << 32 | end) as sorted pairs."""
    x = np.sort(np.asarray(spans, np.int64))
    return np.column_stack([x >> 32, x & 0xFFFFFFFF])


def _scan(length: int, gram: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = []
            for _, texts in vec.blocks(column):
                out += [(hashlib.sha256(t).digest(), len(t), *got) for t, got in zip(texts, anchors(texts, length, gram), strict=True)]
            yield pd.DataFrame(out, columns=["key", "n_bytes", "spans", "hashes", "wholes"])

    return F.pandas_udf(run, "key binary, n_bytes long, spans array<long>, hashes array<long>, wholes array<long>")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(rows, done): rows has row, doc_id, key, n_bytes, copies and rep; done has row, n_removed, n_spans, spans, kept_sha256."""

    seen = docs.select("doc_id", _scan(length, gram)("text").alias("s")).select("doc_id", "s.*")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "anchors")
    # One of equal texts stands for all.
    groups = materialize(seen.groupBy("key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    rows = seen.select("row", "doc_id", "key", "n_bytes").join(groups.hint("merge"), "key")
    reps = seen.join(groups.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi")
    runs = reps.where(F.size("spans") > 0).select("row", F.explode(F.arrays_zip("hashes", "wholes", "spans")).alias("r"))
    runs = materialize(runs.select("row", F.col("r.hashes").alias("hash"), F.col("r.wholes").alias("whole"), F.col("r.spans").alias("span")), "runs")
    often = runs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") < F.max("whole")).alias("varied")).where("n > 1").select("hash", "varied")
    cand = materialize(runs.join(materialize(often, "often").hint("merge"), "hash"), "runs")
    discard(runs)
    # Of equal runs one is compared with the others of its anchor, and all are repeats.
    same = cand.groupBy("hash", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "span")).alias("one")).where("n > 1").drop("n")
    marked = cand.join(materialize(same, "same").hint("merge"), ["hash", "whole"], "left")
    known, sent = F.col("one").isNotNull(), F.col("varied") & (F.col("one").isNull() | (F.col("one") == F.struct("row", "span")))
    spans = marked.groupBy("row").agg(F.collect_list(F.when(known, F.col("span"))).alias("known"), F.collect_list(F.when(sent, F.col("span"))).alias("ranges"))
    spans = spans.join(seen.select("row", F.col("doc_id").alias("c_id"), F.col("key").alias("c_key")).hint("merge"), "row")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    texts = keyed.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key"))).select("row", "text", "known", "ranges")
    # A text comes twice only if a row is there several times over, doc_id and all.
    again = seen.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = materialize(texts if again.isEmpty() else texts.dropDuplicates(["row"]), "candidates")
    discard(cand)
    windows = texts.select(F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(0xFFFFFFFF) - F.shiftright(x, 32)).alias("n")).agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(0, int(windows / RANGE_ROWS)).bit_length()
    shards = _shards(texts.where(F.size("ranges") > 0).select("row", "text", "ranges"), ranges, length, shard)
    parts = _merge_ranges(shards)
    # All ranges' starts of a shard together, as many as it has windows at most.
    found = parts.where("kind = 0").groupBy("shard").agg(F.collect_list("a").alias("a"))
    layout = parts.where("kind = 2").select(F.col("shard").alias("of"), F.col("a").alias("offsets"), F.col("b").alias("owners"), F.col("c").alias("begins"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, offsets, owners, begins in zip(pdf["a"], pdf["offsets"], pdf["owners"], pdf["begins"], strict=True):
                starts = np.unique(np.frombuffer(b"".join(bytes(x) for x in a), np.int32)).astype(np.int64)
                off, own, beg = (np.frombuffer(x, np.int64) for x in (offsets, owners, begins))
                seg = np.searchsorted(off, starts, side="right") - 1
                cut = np.flatnonzero(np.diff(seg)) + 1
                out = []
                for part, k in zip(np.split(starts, cut), seg[np.concatenate([[0], cut])] if len(seg) else [], strict=False):
                    out.append((own[k], _runs(part - off[k] + beg[k]).tobytes()))
                yield pd.DataFrame(out, columns=["row", "runs"])

    placed = found.join(layout.hint("merge"), found.shard == layout.of).select("a", "offsets", "owners", "begins").mapInPandas(place, "row long, runs binary")
    placed = materialize(placed, "placed")
    discard(parts)

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, text, known, parts in zip(pdf["row"], pdf["text"], pdf["known"], pdf["all"], strict=True):
                data = vec.encode(text)
                pairs = np.frombuffer(b"".join(bytes(x) for x in ([] if parts is None else parts)), np.int64).reshape(-1, 2)
                pairs = np.concatenate([pairs, _pairs(known)])
                spans: list[list[int]] = []
                for a, e in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                    e += length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([a, e])
                kept, last = hashlib.sha256(), 0
                for a, e in spans:
                    kept.update(data[last:a])
                    last = e
                kept.update(data[last:])
                out.append((row, sum(e - a for a, e in spans), len(spans), spans, kept.hexdigest()))
            yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "spans", "kept_sha256"])

    by_row = placed.groupBy("row").agg(F.collect_list("runs").alias("all"))
    held = texts.select("row", "text", "known").join(by_row.hint("merge"), "row", "left").where((F.size("known") > 0) | F.col("all").isNotNull())
    done = held.mapInPandas(cut_out, "row long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string")
    return rows, materialize(done, "done")


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows, done = repeats(docs, length, gram, shard)
    r = rows.join(done.withColumnRenamed("row", "d_row").hint("merge"), F.col("rep") == F.col("d_row"), "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = hashlib.sha256(b"").hexdigest()
    return r.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(none)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
