"""A quality classifier with hierarchical empirical Bayes.

Two logistic models, for quality and for toxicity, give the evidence of each
document. Hosts and the paths under them get posterior rates from grouped sums of
that evidence: a path is shrunk toward its host and a host toward the global rate,
the more so the fewer documents it has, by prior strengths that the spread
between sites determines. A document's odds are its own evidence times what its
path's rate adds to the global one.

The models are fitted on at most SAMPLE labelled documents of SAMPLE_BYTES in all,
taken in hash order, by one task, which hands over the weights of telling words
only; sites' rates come from all documents.

Defined cases: a null text counts as empty; null host or path is a site of its
own; labels of unknown documents are ignored and of several labels for a document
the highest counts; of several texts of a labelled document the shortest is fitted,
then the first in order; without labels, or with one class only, that model says the
base rate for everything; repeated rows are scored one by one; an empty table
gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import vec
from palimpsest.llm.common import discard, free_name, materialize

#: Labelled documents to fit on, and their bytes, at most.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
#: Hashed word features.
BUCKETS = 1 << 20
HEADS = ("quality", "toxic")
#: A document is kept if it is probably of quality and probably not toxic.
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5
_SHAPES = 10

# Classes of bytes, for counts: other, lower, upper, digit, blank, line end, common marks, rare marks.
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 6
_CLASS[0] = 0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes (text x 10), and text and bucket of each distinct word."""
    b = vec.Block(texts)
    n = b.n
    counts = np.bincount(b.owner(np.arange(len(b.raw))) * 8 + _CLASS[b.raw], minlength=8 * n).reshape(n, 8).astype(float)
    total = np.maximum(1.0, counts[:, 1:].sum(axis=1))
    h, own = vec.word_hashes(b)
    words = np.bincount(own, minlength=n)
    pairs = np.unique(own * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    of, bucket = pairs // BUCKETS, pairs % BUCKETS
    distinct = np.bincount(of, minlength=n)
    shape = np.column_stack([
        np.log1p(words), distinct / np.maximum(1, words), counts[:, 2] / total, counts[:, 3] / total, counts[:, 4] / total,
        counts[:, 5] / total, counts[:, 6] / total, counts[:, 7] / total, total / np.maximum(1, words), words == 0,
    ])
    return shape, of, bucket


class Logistic:
    """Weights of shapes and of the known words; fitted by full-batch gradients."""

    def __init__(self, mean, scale, shape_w, known, word_w, bias):
        self.mean, self.scale, self.shape_w, self.known, self.word_w, self.bias = mean, scale, shape_w, known, word_w, bias

    def logit(self, shape: np.ndarray, of: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        x = np.clip((shape - self.mean) / self.scale, -4, 4)
        out = x @ self.shape_w + self.bias
        if len(self.known):
            hit, place = self.among(bucket)
            out += np.bincount(of[hit], weights=self.word_w[place[hit]], minlength=len(shape))
        return out

    def among(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the buckets are known, and their places among these."""
        place = np.minimum(np.searchsorted(self.known, bucket), max(0, len(self.known) - 1))
        return self.known[place] == bucket if len(self.known) else np.zeros(len(bucket), bool), place

    @classmethod
    def fit(cls, shape: np.ndarray, of: np.ndarray, bucket: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> Logistic:
        n = len(y)
        mean, scale = (shape.mean(axis=0), shape.std(axis=0) + 1e-6) if n else (np.zeros(_SHAPES), np.ones(_SHAPES))
        rate = (y.sum() + 1) / (n + 2)
        none = np.zeros(0)
        m = cls(mean, scale, np.zeros(_SHAPES), none.astype(np.int64), none, float(np.log(rate / (1 - rate))))
        if not n or y.min() == y.max():
            return m
        x = np.clip((shape - mean) / scale, -4, 4)
        # Only words that tell the classes apart beyond chance.
        m.known = np.flatnonzero(_telling(of, bucket, y))
        hit, place = m.among(bucket)
        of, word = of[hit], place[hit]
        w, size = np.zeros(len(m.known)), len(m.known)
        sums = [np.full(_SHAPES, 1e-8), np.full(size, 1e-8), 1e-8]
        for _ in range(rounds):
            z = x @ m.shape_w + np.bincount(of, weights=w[word], minlength=n) + m.bias
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            grads = [x.T @ e + l2 * m.shape_w, np.bincount(word, weights=e[of], minlength=size) + l2 * w, e.sum()]
            sums = [s + g * g for s, g in zip(sums, grads, strict=True)]
            steps = [0.3 * g / np.sqrt(s) for g, s in zip(grads, sums, strict=True)]
            m.shape_w, w, m.bias = m.shape_w - steps[0], w - steps[1], m.bias - steps[2]
        m.word_w = w
        return m


def _telling(of: np.ndarray, bucket: np.ndarray, y: np.ndarray, least: float = 25.0) -> np.ndarray:
    """Buckets whose log-likelihood ratio against the class is high."""
    n, n1 = len(y), y.sum()
    a = np.bincount(bucket, weights=y[of], minlength=BUCKETS)
    k = np.bincount(bucket, minlength=BUCKETS)
    cells = ((a, k * n1 / n), (k - a, k * (n - n1) / n), (n1 - a, (n - k) * n1 / n), (n - n1 - k + a, (n - k) * (n - n1) / n))
    g = 2 * sum(o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)) for o, e in cells)
    return g >= least


def _fit(got: pd.DataFrame) -> list[Logistic]:
    parts = [(first, *features(held)) for first, held in vec.blocks(got["text"])]
    shape = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, _SHAPES))
    of = np.concatenate([p[2] + p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    bucket = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
    out = []
    for h in HEADS:
        y = got[f"is_{h}"].to_numpy(dtype=float)
        ok = ~np.isnan(y)
        rank = np.cumsum(ok) - 1
        inside = ok[of] if len(of) else np.zeros(0, bool)
        out.append(Logistic.fit(shape[ok], rank[of[inside]] if len(of) else of, bucket[inside], y[ok]))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[Logistic]:
    """The models of HEADS from at most sample labelled documents."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(*[F.max(h).cast("double").alias(f"is_{h}") for h in HEADS])
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(sample)
    )
    # The sample is of a fixed size, so it can go to every task.
    text = F.coalesce("text", F.lit(""))
    heads = [f"is_{h}" for h in HEADS]
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    got = got.groupBy("l_id", *heads).agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("t"))
    got = materialize(got.select("l_id", *heads, "t.size", "t.text"), "sample")
    upto = F.sum("size").over(W.orderBy(F.xxhash64("l_id"), "l_id"))  # of sample rows at most
    few = got.select("l_id", "size").withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("l_id")
    rows = got.join(F.broadcast(few), "l_id", "left_semi").repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        pdf = pd.concat(held).sort_values("l_id") if held else pd.DataFrame({c: [] for c in ["l_id", "text", *heads]})
        yield pd.DataFrame({"model": [pickle.dumps(_fit(pdf))]})

    # Known words and their weights: some thousands of numbers.
    out = rows.select("l_id", "text", *heads).mapInPandas(run, "model binary").first()
    discard(got)
    return pickle.loads(bytes(out.model)) if out else _fit(pd.DataFrame({c: [] for c in ["text", *heads]}))


def scored(text: Column, models: list[Logistic], names: list[str]) -> Column:
    """A struct of the logit of each head."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            logits = np.zeros((len(names), len(column)))
            for first, texts in vec.blocks(column):
                f = features(texts)
                for k, m in enumerate(models):
                    logits[k, first : first + len(texts)] = m.logit(*f)
            yield pd.DataFrame(dict(zip(names, logits, strict=True)))

    return F.pandas_udf(score, ", ".join(f"{n} double" for n in names))(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def sites(evidence: DataFrame, heads: list[str]) -> DataFrame:
    """Host, path and, for each head, what the site adds to a logit.

    evidence: (host, path, logits...). Sums are combined before the shuffle.
    """
    p = {h: _sigmoid(F.col(h)) for h in heads}
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p[h]).alias(f"s_{h}") for h in heads])
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{h}").alias(f"hs_{h}") for h in heads])
    whole = hosts.agg(F.sum("hn").alias("n"), F.count(F.lit(1)).alias("k"), *[F.sum(f"hs_{h}").alias(h) for h in heads]).first()
    n = max(1, whole.n or 0)
    out = paths.join(hosts.withColumnRenamed("host", "h_host"), F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    for h in heads:
        mu = min(1 - 1e-6, max(1e-6, (whole[h] or 0.0) / n))
        strength = _strength(hosts.select((F.col(f"hs_{h}") / F.col("hn")).alias("rate"), F.col("hn").alias("n")), mu)
        host_rate = (F.col(f"hs_{h}") + strength * mu) / (F.col("hn") + strength)
        rate = (F.col(f"s_{h}") + strength * host_rate) / (F.col("n") + strength)
        out = out.withColumn(f"host_{h}", host_rate).withColumn(f"site_{h}", rate).withColumn(f"add_{h}", _logit(F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))) - float(np.log(mu / (1 - mu))))
    return materialize(out.select("host", "path", *[f"{a}_{h}" for h in heads for a in ("site", "add")]), "sites")


def _strength(rates: DataFrame, mu: float) -> float:
    """The prior's weight in documents, by moments: noise against spread between sites."""
    got = rates.agg(F.sum(F.col("n") * (F.col("rate") - mu) ** 2).alias("ss"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not got.n:
        return 1.0
    within = mu * (1 - mu)
    spread = max(1e-9, (got.ss - (got.k - 1) * within) / got.n)
    return float(min(1e4, max(1.0, within / spread - 1)))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """docs (or these columns of it) with p_doc, p_site, p_quality, p_toxic and kept."""
    models = fit(docs, labels, sample)
    heads = list(HEADS)
    columns = docs.columns if columns is None else columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")  # so that no name clashes
    rows = docs.select(own, (F.col("source") if host is None else host).alias("host"), (F.col("lang") if path is None else path).alias("path"), scored(F.col("text"), models, heads).alias("z"))
    # Written once, as the texts would go to Python again for each use.
    rows = materialize(rows.select("own", "host", "path", "z.*"), "evidence")
    site = sites(rows.select("host", "path", *heads), heads).withColumnsRenamed({"host": "s_host", "path": "s_path"})
    rows = rows.join(site, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    quality, toxic = (_sigmoid(F.col(h) + F.col(f"add_{h}")) for h in heads)
    got = [_sigmoid(F.col("quality")), F.col("site_quality"), quality, toxic, (quality >= MIN_QUALITY) & (toxic < MAX_TOXIC)]
    out = free_name(docs.select(*[f"`{c}`" for c in columns]), "p_doc", "p_site", "p_quality", "p_toxic", "kept")
    return rows.select(*[F.col("own").getField(c).alias(c) for c in columns], *[g.alias(n) for g, n in zip(got, out, strict=True)])
