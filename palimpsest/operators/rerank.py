"""Diversifying and learned re-ranking.

Greedy and trained orders need all of a query's candidates together. These are the
first hits of one query, a list of bounded length, so each goes to one applyInPandas
group; queries are spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mmr(cands: DataFrame, lam: float = 0.5, k: int = 10) -> DataFrame:
    """(qid, doc_id, place): maximal marginal relevance, from (qid, doc_id, score, tokens)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in pdf["tokens"]]
        near, left, order = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(order) < k:
            best = max(left, key=lambda i: (lam * pdf["score"][i] - (1 - lam) * near[i], -i))
            order.append(best)
            left.remove(best)
            for i in left:
                union = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / union if union else 0.0)
        return pd.DataFrame({"qid": pdf["qid"][0], "doc_id": pdf["doc_id"][order].to_numpy(), "place": range(len(order))})

    return cands.groupBy("qid").applyInPandas(pick, "qid long, doc_id long, place int")


def xquad(cands: DataFrame, lam: float = 0.5, k: int = 10) -> DataFrame:
    """(qid, doc_id, place): rewards aspects not covered yet, from (qid, doc_id, score, aspects)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(a) for a in pdf["aspects"]]
        total, covered = max(1, len(set().union(*sets))), set()
        left, order = list(range(len(pdf))), []
        while left and len(order) < k:
            best = max(left, key=lambda i: ((1 - lam) * pdf["score"][i] + lam * len(sets[i] - covered) / total, -i))
            order.append(best)
            left.remove(best)
            covered |= sets[best]
        return pd.DataFrame({"qid": pdf["qid"][0], "doc_id": pdf["doc_id"][order].to_numpy(), "place": range(len(order))})

    return cands.groupBy("qid").applyInPandas(pick, "qid long, doc_id long, place int")


def _ndcg(scores: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    gain = lambda rel: ((2.0**rel - 1) / np.log2(np.arange(2, len(rel) + 2))).sum()
    ideal = gain(np.sort(y)[::-1][:k])
    return gain(y[np.argsort(-scores, kind="stable")][:k]) / ideal if ideal else 0.0


def coordinate_ascent(x: np.ndarray, y: np.ndarray, group: np.ndarray, rounds: int = 5, steps=(-0.5, -0.1, 0.1, 0.5)) -> np.ndarray:
    """Weights of a linear ranker that raise the mean NDCG of the labels, one at a time."""
    groups = [np.flatnonzero(group == g) for g in np.unique(group)]
    value = lambda w: np.mean([_ndcg(x[g] @ w, y[g]) for g in groups])
    w = np.ones(x.shape[1]) / x.shape[1]
    best = value(w)
    for _ in range(rounds):
        for j in range(len(w)):
            for s in steps:
                v = w.copy()
                v[j] += s
                if (got := value(v)) > best + 1e-12:
                    w, best = v, got
    return w


def rank_svm(x: np.ndarray, y: np.ndarray, group: np.ndarray, epochs: int = 20, rate: float = 0.05, c: float = 0.01, seed: int = 42) -> np.ndarray:
    """Weights by hinge-loss descent over pairs of one query, margin 1."""
    pairs = [(i, j) for g in np.unique(group) for i in np.flatnonzero(group == g) for j in np.flatnonzero(group == g) if y[i] > y[j]]
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
    for _ in range(epochs):
        for p in rng.permutation(len(pairs)):
            i, j = pairs[p]
            d = x[i] - x[j]
            w = (1 - rate * c) * w + (rate * d if w @ d < 1 else 0)
    return w


def rank_boost(x: np.ndarray, y: np.ndarray, group: np.ndarray, rounds: int = 10, cuts: int = 16) -> list[tuple[int, float, float]]:
    """Threshold stumps (feature, cut, weight) boosted over pairs of one query.

    A stump without error is kept, at a bounded weight, and ends the boosting.
    """
    pairs = np.array([(i, j) for g in np.unique(group) for i in np.flatnonzero(group == g) for j in np.flatnonzero(group == g) if y[i] > y[j]]).reshape(-1, 2)
    out: list[tuple[int, float, float]] = []
    if not len(pairs):
        return out
    d = np.full(len(pairs), 1 / len(pairs))
    stumps = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts)))]
    votes = np.array([np.where(x[:, f] > c, 1.0, -1.0) for f, c in stumps])
    diff = (votes[:, pairs[:, 0]] - votes[:, pairs[:, 1]]) / 2
    for _ in range(rounds):
        r = diff @ d
        k = int(np.argmax(np.abs(r)))
        a = 0.5 * np.log((1 + r[k] + 1e-6) / (1 - r[k] + 1e-6))
        if abs(a) < 1e-9:
            break
        out.append((stumps[k][0], float(stumps[k][1]), float(a)))
        if abs(r[k]) > 1 - 1e-9:
            break
        d = d * np.exp(-a * diff[k])
        d /= d.sum()
    return out


def linear_score(features: Column, weights) -> Column:
    """The dot product of an array of features with fixed weights."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def boosted_score(features: Column, stumps: list[tuple[int, float, float]]) -> Column:
    out = F.lit(0.0)
    for f, cut, a in stumps:
        out = out + F.when(F.get(features, F.lit(f)) > cut, a).otherwise(-a)
    return out


def lexical_reranker(pairs: DataFrame) -> DataFrame:
    """A stand-in for a cross-encoder: the share of the query's words that the text holds."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\W+"))
    share = F.size(F.array_intersect(words("query"), words("text"))) / F.greatest(F.size(words("query")), F.lit(1))
    return pairs.select("qid", "doc_id", share.alias("rerank_score"))
