"""Near-duplicates by Order MinHash.

A text's k-mers are its runs of WORDS words, labelled with their occurrence, so
that repeats differ. Each of SKETCHES hash functions picks the LENGTH smallest
k-mers; kept in text order, they are one sketch. Texts that agree in a sketch are
candidates: k-mers that agree but stand in another order don't make one.

Candidates are verified by a banded alignment of the k-mer sequences: with c
k-mers aligned of n and m, the similarity is c / (n + m - c), and pairs of
THRESHOLD or more are linked. Classes are the connected components.

To spare large groups all their pairs, each bucket first aligns its members with
one leader, the one with the most company in all buckets. Members that ended up
in the leader's class need no more. Across classes, pairs are found by how the
members differ from their leader. With d the number of k-mers by which a text
differs from the leader, two texts differ by d1 + d2 - 2 o, where o is how many of
these differences they share; alike texts differ by a ninth of their k-mers at most
(for a threshold of 0.8), so that o has a lower bound. If neither shares a
difference with the other, the one that is too far from the leader is too far from
the other, too. So texts are joined by differences, rarest first, and only as many of
them as the bound asks for; pairs that can't reach the bound even with all later
differences are left out by the join. Thus rows grow with the texts and not with the
pairs of a bucket, and no link is lost. Only texts near the leader in k-mers but not
in their order are paired directly. Texts of which too few k-mers occur in other
classes are left out before that.

Defined cases: texts with the same words (ASCII case and punctuation aside) are
one class and are collapsed before anything else; a text of fewer than WORDS words
is one k-mer, so it is only like texts with the same words; null and empty texts
have no words and form one class; repeated rows each get a row; an empty table
gives an empty result; extra columns are ignored or pass through.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import vec
from palimpsest.llm.common import discard, free_name, materialize

WORDS, THRESHOLD = 5, 0.8
#: At similarity 0.8 a sketch agrees with probability 0.8 ** LENGTH, so that of long
#: texts one pair in ten million is missed; of very short ones more: 4 k-mers and the
#: same with a fifth agree with probability 0.2, so that one pair in 1300 is missed.
SKETCHES, LENGTH = 32, 4
#: K-mers expected below a text's threshold, of which the LENGTH smallest are taken.
_EXPECT = 24

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)


def kmers(hashes: np.ndarray, own: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all texts; of a short text that of all its words."""
    h, o = vec.shingles(hashes, own, WORDS)
    n = np.bincount(own, minlength=n_texts)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        first = np.searchsorted(own, short)
        whole = np.array([vec.mix(np.array([_fold(hashes[a : a + c])], dtype=np.uint64))[0] for a, c in zip(first, n[short], strict=True)], dtype=np.uint64)
        h, o = np.concatenate([h, whole]), np.concatenate([o, short])
        order = np.argsort(o, kind="stable")
        h, o = h[order], o[order]
    return h, o


def _fold(hashes: np.ndarray) -> int:
    x = len(hashes)
    for h in hashes.tolist():
        x = (x * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return x


def occurrences(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """How many equal k-mers of the same text come before each."""
    key = h ^ vec.mix(o.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    if new.all():
        return np.zeros(len(h), np.uint64)
    begin = np.flatnonzero(new)
    nth = np.arange(len(s)) - begin[np.cumsum(new) - 1]
    out = np.empty(len(h), np.uint64)
    out[order] = nth.astype(np.uint64)
    return out


def sketches(h: np.ndarray, o: np.ndarray, n_texts: int) -> np.ndarray:
    """(texts x SKETCHES) keys; 0 for texts without k-mers."""
    out = np.zeros((n_texts, SKETCHES), dtype=np.uint64)
    if not len(h):
        return out
    label = vec.mix(h + vec.mix(occurrences(h, o) + np.uint64(1)))
    n = np.bincount(o, minlength=n_texts)
    has = np.flatnonzero(n)
    limit = np.where(n > _EXPECT, _EXPECT / np.maximum(1, n), 1.0)
    cut = np.minimum(limit * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
    cut[n <= _EXPECT] = np.uint64(0xFFFFFFFFFFFFFFFF)
    cut_of = cut[o]
    for j in range(SKETCHES):
        v = label * _MULTIPLY[j] + _ADD[j]
        at = np.flatnonzero(v <= cut_of)
        few = np.flatnonzero(np.bincount(o[at], minlength=n_texts) < np.minimum(n, LENGTH))
        if len(few):  # rare: look at all k-mers of these texts
            at = np.union1d(at, np.flatnonzero(np.isin(o, few)))
        oa = o[at]
        order = np.lexsort((v[at], oa))
        at, oa = at[order], oa[order]
        first = np.searchsorted(oa, has)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        chosen = np.sort(at[rank < LENGTH])  # text order
        x, ox = label[chosen], o[chosen]
        place = np.arange(len(x)) - np.searchsorted(ox, ox)
        key = np.zeros(n_texts, dtype=np.uint64)
        for p in range(LENGTH):
            here = place == p
            key[ox[here]] = vec.mix(key[ox[here]] * np.uint64(0x9E3779B97F4A7C15) + x[here])
        out[has, j] = vec.mix(key[has] + np.uint64(j + 1))
    return out


def _wkeys(block: vec.Block) -> list[bytes]:
    """A digest of each text's words, joined by blanks."""
    word = vec.IS_WORD[block.low]
    keep = word.copy()
    keep[1:] |= word[:-1]  # a blank after each word
    plain = np.where(word, block.low, np.uint8(32))[keep].tobytes()
    place = np.concatenate([[0], np.cumsum(keep)])
    return [hashlib.md5(plain[x:y].rstrip(b" ")).digest() for x, y in zip(place[block.starts].tolist(), place[block.ends].tolist(), strict=True)]


def _signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for column in batches:
        parts = []
        for _, texts in vec.blocks(column):
            block = vec.Block(texts)
            hashes, own = vec.word_hashes(block)
            h, o = kmers(hashes, own, block.n)
            keys = sketches(h, o, block.n).view(np.int64)
            parts.append(pd.DataFrame({"wkey": _wkeys(block), "n": np.bincount(o, minlength=block.n), "keys": list(keys)}))
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"wkey": [], "n": [], "keys": []})


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (digest of the text), wkey, n (k-mers) and sketches of each row."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("tkey"), F.pandas_udf(_signature, "wkey binary, n long, keys array<long>")("text").alias("s"))
    return materialize(slim.select("doc_id", "tkey", "s.wkey", "s.n", "s.keys"), "sketches")


def align(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """c / (n + m - c) for the best alignment of c k-mers within the band, or 0.

    The band is as wide as a pair of the threshold can drift. 0 stands for any
    value below the threshold.
    """
    n, m = len(a), len(b)
    least = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))  # aligned k-mers needed
    if n == 0 or m == 0 or min(n, m) < least:
        return 0.0
    band = n + m - 2 * least
    order = np.argsort(b, kind="stable")
    s = b[order]
    lo, hi = np.searchsorted(s, a, "left"), np.searchsorted(s, a, "right")
    many = hi - lo
    if np.count_nonzero(many) < least:
        return 0.0
    if many.max() <= 1:
        i = np.flatnonzero(many)
        j = order[lo[i]]
        near = np.abs(i - j) <= band
        j = j[near]
        c = len(j) if len(j) < 2 or (np.diff(j) > 0).all() else _rising(j.tolist())
    elif many.sum() <= 8 * (n + m):
        js: list[int] = []
        for i in np.flatnonzero(many).tolist():
            js += [x for x in order[lo[i] : hi[i]][::-1].tolist() if abs(x - i) <= band]
        c = _rising(js)
    else:
        c = _dense(a, b, band)
    sim = c / (n + m - c)
    return sim if sim >= threshold - 1e-12 else 0.0


def _rising(js: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    tails: list[int] = []
    for j in js:
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
        else:
            tails[at] = j
    return len(tails)


def _dense(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Aligned k-mers by rows of the banded table, for texts of many repeats."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for i in range(len(a)):
        lo, hi = max(0, i - band), min(len(b), i + band + 1)
        if lo >= hi:
            continue
        best = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (b[lo:hi] == a[i]))
        row[lo + 1 : hi + 1] = np.maximum(np.maximum.accumulate(best), row[lo])
    return int(row.max())


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wkey and seq (32 bits of each k-mer's hash) of the wanted texts (doc_id, tkey, wkey)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, texts in vec.blocks(pdf["text"]):
                block = vec.Block(texts)
                hashes, own = vec.word_hashes(block)
                h, o = kmers(hashes, own, block.n)
                small = (h >> np.uint64(32)).astype(np.uint32)
                cut = np.searchsorted(o, np.arange(block.n + 1))
                yield pd.DataFrame({"wkey": pdf["wkey"].iloc[first : first + len(texts)].array, "seq": [small[cut[i] : cut[i + 1]].view(np.int32) for i in range(block.n)]})

    ids = wanted.select(F.col("doc_id").alias("w_id"), F.col("tkey").alias("w_key"), "wkey")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tkey"))
    rows = keyed.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tkey") == F.col("w_key"))).select("text", "wkey")
    return rows.mapInPandas(run, "wkey binary, seq array<int>").dropDuplicates(["wkey"])


def _verified(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are alike, with their similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sim = np.array([align(np.asarray(x, np.int32), np.asarray(y, np.int32), threshold) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)], dtype=float)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": sim})[sim > 0]

    left = seqs.select(F.col("wkey").alias("a"), F.col("seq").alias("sa"))
    right = seqs.select(F.col("wkey").alias("b"), F.col("seq").alias("sb"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb")
    return materialize(joined.mapInPandas(run, "a binary, b binary, similarity double"), "links")


def components(links: DataFrame) -> DataFrame:
    """wkey and comp (the smallest wkey that can be reached) of all linked texts."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "edges")
    label = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")), "label")
    while True:
        # The least label around, then the label of that label's text.
        around = both.join(label.withColumnsRenamed({"u": "v"}).hint("merge"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        low = materialize(label.join(around, "u").select("u", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved")), "low")
        if low.where("moved").isEmpty():
            discard(both)
            discard(low)
            return label.withColumnRenamed("u", "wkey")
        jump = low.select(F.col("u").alias("comp"), F.col("comp").alias("far"))
        nxt = materialize(low.join(jump.hint("merge"), "comp", "left").select("u", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "label")
        discard(label)
        discard(low)
        label = nxt


def _mixed(member: DataFrame, by: str) -> DataFrame:
    """The rows of buckets or groups that hold several classes."""
    c = F.xxhash64("comp")
    keys = member.groupBy(by).agg(F.min(c).alias("x"), F.max(c).alias("y")).where("x < y").select(by)
    return materialize(member.join(materialize(keys, "mixed").hint("merge"), by, "left_semi"), "members")


def _crossing(member: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """wkey of the members of which enough k-mers occur in other classes.

    c aligned k-mers of n and m make threshold * (n + m - c) at most, so that c is
    at least threshold * n, and each of them is in the other text's class.
    """
    texts = member.select("wkey", F.xxhash64("comp").alias("of"), "n").distinct()
    grams = texts.join(seqs.hint("merge"), "wkey").select("wkey", "of", "n", F.explode("seq").alias("gram"))
    both = grams.groupBy("gram").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x < y").select("gram")
    both = materialize(both, "grams")
    shared = grams.join(both.hint("merge"), "gram", "left_semi").groupBy("wkey", "n").agg(F.count(F.lit(1)).alias("c"))
    return materialize(shared.where(F.col("c") >= threshold * F.col("n") - 1e-6).select("wkey"), "able")


def differences(seq: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """64-bit values of the k-mers, with their occurrence, that only one of the two has."""
    both = [x.astype(np.int64).view(np.uint64) for x in (seq, leader)]
    a, b = (vec.mix(x + vec.mix(occurrences(x, np.zeros(len(x), np.int64)) + np.uint64(1))) for x in both)
    return np.setxor1d(a, b, assume_unique=True).view(np.int64)


def _differing(groups: DataFrame, seqs: DataFrame) -> DataFrame:
    """groups with m (the leader's k-mers), d (the number of differences) and diff (the differences)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            diff = [differences(np.asarray(x, np.int32), np.asarray(y, np.int32)) for x, y in zip(pdf["seq"], pdf["lead"], strict=True)]
            out = pdf.drop(columns=["seq", "lead"])
            out["m"], out["d"], out["diff"] = pdf["lead"].map(len), [len(x) for x in diff], diff
            yield out

    lead = seqs.select(F.col("wkey").alias("leader"), F.col("seq").alias("lead"))
    joined = groups.join(seqs.hint("merge"), "wkey").join(lead.hint("merge"), "leader").select("leader", "wkey", "comp", "n", "seq", "lead")
    return materialize(joined.mapInPandas(run, "leader binary, wkey binary, comp binary, n long, m long, d long, diff array<long>"), "differing")


def _across(member: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts of one leader but of two classes that can be alike.

    member: leader, wkey, comp, n. Alike texts of n1 and n2 k-mers differ by
    slack * (n1 + n2) of them at most.
    """
    slack = (1 - threshold) / (1 + threshold)
    # Written first, or else the join below would go before distinct() and deal by leader.
    once = materialize(member.select("leader", "wkey", "comp", "n").distinct(), "led")
    groups = _differing(_mixed(once, "leader"), seqs)
    groups = materialize(groups.withColumn("far", F.col("d") > slack * (F.col("n") + F.col("m")) + 1e-6), "groups")
    each = groups.select("leader", "wkey", "comp", "n", "m", "d", "far", F.explode("diff").alias("token"))
    often = each.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = each.join(materialize(often, "often").hint("merge"), ["leader", "token"])
    # Differences in order of how rare they are; those of one text alone come first.
    ranked = held.groupBy("leader", "wkey", "comp", "n", "m", "d", "far").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    # Differences that a partner must share at least. A partner with o of them has m + o
    # k-mers at most, from which the bound of a far text follows; a near one's holds for far partners.
    least_far = (F.col("d") - slack * (F.col("n") + F.col("m"))) / (1 + slack)
    least_near = (F.col("d") + slack * (F.col("m") - F.col("n"))) / 2
    need = F.greatest(F.lit(1), F.ceil(F.when(F.col("far"), least_far).otherwise(least_near) - 1e-6))
    ranked = ranked.withColumn("left", F.size("t")).withColumn("t", F.slice("t", F.lit(1), F.greatest(F.lit(0), F.col("left") - need + 1).cast("int")))
    rows = ranked.select("leader", "wkey", "comp", "n", "far", "d", "left", F.posexplode("t").alias("at", "t"))
    rows = rows.select("leader", "wkey", "comp", "n", "far", "d", F.col("t.token").alias("token"), (F.col("left") - F.col("at")).alias("left"))
    rows = materialize(rows, "prefixes")
    u, w = rows.where("far").alias("u"), rows.alias("w").hint("merge")
    apart = (F.col("u.comp") != F.col("w.comp")) & (F.least("u.n", "w.n") >= (threshold - 1e-9) * F.greatest("u.n", "w.n"))
    bound = 2 * F.least("u.left", "w.left") >= F.col("u.d") + F.col("w.d") - slack * (F.col("u.n") + F.col("w.n")) - 1e-6
    once = ~F.col("w.far") | (F.col("u.wkey") < F.col("w.wkey"))
    same = (F.col("u.leader") == F.col("w.leader")) & (F.col("u.token") == F.col("w.token"))
    by_token = u.join(w, same & apart & bound & once)
    # Near the leader in k-mers, but in another class: the order differs.
    near = groups.where("not far").select("leader", "wkey", "comp", "n")
    near = _mixed(near, "leader")
    directly = near.alias("u").join(near.alias("w").hint("merge"), (F.col("u.leader") == F.col("w.leader")) & apart & (F.col("u.wkey") < F.col("w.wkey")))
    both = by_token.select("u.wkey", F.col("w.wkey").alias("other")).union(directly.select("u.wkey", F.col("w.wkey").alias("other")))
    return both.select(F.least("wkey", "other").alias("a"), F.greatest("wkey", "other").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, reps, links): rows as signatures(), reps (wkey, comp, class_id, n_links), links."""
    rows = signatures(docs)
    texts = materialize(
        rows.groupBy("wkey").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("wkey", "row.doc_id", "row.tkey", "n", "keys"), "texts"
    )
    held = texts.where(F.col("n") > 0).select("wkey", "n", F.explode("keys").alias("key"))
    sized = held.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(held.join(materialize(sized, "sizes").hint("merge"), "key"), "shared")
    # The leader is the member with the most company over all its buckets: of many
    # variants the one that the others vary.
    central = materialize(shared.groupBy("wkey").agg(F.sum("size").alias("weight")), "central")
    placed = materialize(shared.join(central.hint("merge"), "wkey").select("key", "wkey", "n", "weight"), "placed")
    leaders = materialize(placed.groupBy("key").agg(F.max(F.struct("weight", "wkey")).alias("m")).select("key", F.col("m.wkey").alias("leader")), "leaders")
    buckets = materialize(placed.drop("weight").join(leaders.hint("merge"), "key"), "buckets")
    sizes = texts.select("wkey", "n")
    star = buckets.where("leader <> wkey").select(F.col("leader").alias("a"), F.col("wkey").alias("b"), "n").distinct()
    low = threshold * (1 - 1e-9)
    star = star.join(sizes.withColumnsRenamed({"wkey": "a", "n": "na"}).hint("merge"), "a").where(F.least("n", "na") >= low * F.greatest("n", "na"))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = materialize(star, "star")
    wanted = buckets.select("wkey").distinct().join(texts.select("wkey", "doc_id", "tkey").hint("merge"), "wkey")
    seqs = materialize(_sequences(docs, wanted), "sequences")
    first = _verified(star, seqs, threshold)
    comp = components(first)
    # Buckets whose members are of several classes still.
    labelled = buckets.join(comp.hint("merge"), "wkey", "left").select("key", "leader", "wkey", "n", F.coalesce("comp", "wkey").alias("comp"))
    member = _mixed(materialize(labelled, "labelled"), "key")
    member = _mixed(materialize(member.join(_crossing(member, seqs, threshold).hint("merge"), "wkey", "left_semi"), "crossing"), "key")
    cross = materialize(_across(member, seqs, threshold).join(star.hint("merge"), ["a", "b"], "left_anti"), "cross")
    second = _verified(cross, seqs, threshold)
    links = first.unionByName(second)
    if not second.isEmpty():
        comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("wkey")).groupBy("wkey").agg(F.count(F.lit(1)).alias("n_links"))
    full = texts.select("wkey", "doc_id", "n").join(comp.hint("merge"), "wkey", "left").join(degree.hint("merge"), "wkey", "left")
    full = materialize(full.select("wkey", "doc_id", F.coalesce("comp", "wkey").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "full")
    ids = full.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    reps = materialize(full.drop("doc_id").join(materialize(ids, "ids").hint("merge"), "comp"), "reps")
    return rows, reps, links


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_texts (different texts in the class) and n_links of each row."""
    rows, reps, _ = classes(docs, threshold)
    return rows.select("doc_id", "wkey").join(reps.hint("merge"), "wkey").select("doc_id", "class_id", F.col("n_texts").cast("long").alias("n_texts"), F.col("n_links").cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with one of each class: that of the smallest doc_id."""
    rows, reps, _ = classes(docs, threshold)
    own = rows.select("doc_id", "tkey", "wkey").join(reps.select("wkey", "comp").hint("merge"), "wkey")
    own = materialize(own.groupBy("comp", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n_same")), "own")
    best = own.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey", "n_same")).alias("best"))
    k_id, k_text, k_n, t = free_name(docs, "keep_id", "keep_text", "n_same", "text_key")
    keep = materialize(best.select(F.col("best.doc_id").alias(k_id), F.col("best.tkey").alias(k_text), F.col("best.n_same").alias(k_n)), "keep")
    tagged = docs.withColumn(t, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    kept = tagged.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(t) == F.col(k_text)))
    once = kept.where(F.col(k_n) == 1).select(docs.columns)
    again = kept.where(F.col(k_n) > 1).dropDuplicates([t]).select(docs.columns)
    return once.unionByName(again)
