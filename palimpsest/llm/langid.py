"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over
byte n-grams (ridge regression on Hellinger-scaled counts) is fitted; its margin
on a text predicts the bit. Decoding sums, over the bits, a logistic loss of the
margins against each codeword, weighted by the bit's accuracy, and takes the
nearest codeword. Texts whose two nearest codewords are close are flagged.

Fitted on at most PER_LANG texts of each language, TOTAL texts and BYTES in all,
taken in hash order from the learning fold.

Defined cases: a null text, or one without a letter, is "und" with score 0 and
isn't ambiguous; with no language to learn everything is "und"; with one, every
text with a letter is it; repeated rows are predicted one by one; an empty table
gives an empty result; extra columns are ignored. Only the text enters a prediction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import vec

PER_LANG, TOTAL = 300, 2400
#: Bytes of text to learn from, shared by the languages alike; a language's last text may go beyond.
BYTES = 64 << 20
#: Hashed features: bigrams in the first half, trigrams in the second.
DIM = 4096
RIDGE, MARGIN = 0.02, 0.15
_SCHEMA = "lang_pred string, score double, ambiguous boolean"
#: Texts turned into features at a time.
_ROWS = 128


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram shares: rows of length one."""
    b = vec.Block(texts)
    out = np.zeros((b.n, DIM), dtype=np.float32)
    if b.n == 0:
        return out
    # Runs of anything but letters count as one blank, at the ends too.
    letter = ((b.low >= 97) & (b.low <= 122)) | (b.low >= 128)
    ends = b.raw == 0
    keep = letter | np.concatenate([[True], letter[:-1]]) | ends
    own = b.owner(np.flatnonzero(keep))
    c = np.where(letter, b.low, 32)[keep].astype(np.int64)
    half = DIM // 2
    for first in range(0, b.n, _ROWS):
        lo, hi = np.searchsorted(own, [first, min(b.n, first + _ROWS)])
        x, o = c[lo:hi], own[lo:hi] - first
        n = min(b.n, first + _ROWS) - first
        two = (x[:-1] * 257 + x[1:]) * 40503 >> 4
        three = ((x[:-2] * 257 + x[1:-1]) * 263 + x[2:]) * 2654435761 >> 13
        one = np.bincount((o[:-1] * half + two % half)[o[:-1] == o[1:]], minlength=n * half).reshape(n, half)
        tri = np.bincount((o[:-2] * half + three % half)[o[:-2] == o[2:]], minlength=n * half).reshape(n, half)
        out[first : first + n, :half], out[first : first + n, half:] = one, tri
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all splits if few, else random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 or not (k >> (i - 1)) & 1 else -1 for k in bits] for i in range(n)], dtype=float)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(12 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        gram = code @ code.T
        np.fill_diagonal(gram, -width)
        apart = width - gram.max()
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


class Decoder:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    @classmethod
    def fit(cls, texts: list[bytes], langs: list[str]) -> Decoder:
        names = sorted(set(langs))
        code = codewords(len(names))
        if len(names) < 2:
            return cls(names, code, np.zeros((DIM, 1), np.float32), np.ones(1), np.ones(1))
        x = features(texts)
        mean = x.mean(axis=0)
        y = code[[names.index(lang) for lang in langs]]
        z = x - mean
        # Ridge in its dual form: as many unknowns as texts.
        a = np.linalg.solve((z @ z.T).astype(float) + RIDGE * np.eye(len(z)), y - y.mean(axis=0))
        w = (z.T @ a).astype(np.float32)
        bias = y.mean(axis=0) - mean @ w
        right = ((x @ w + bias) * y > 0).mean(axis=0)
        trust = np.clip(np.log(np.maximum(right, 0.5) / np.maximum(1 - right, 1e-3)), 0.01, None)
        return cls(names, code, w, bias, trust / trust.sum())

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        margins = 2.5 * (features(texts) @ self.weights + self.bias)
        # Loss of each codeword: log(1 + exp(-margin * bit)), weighted by the bit's trust.
        loss = np.stack([np.log1p(np.exp(-np.clip(margins * c, -30, 30))) @ self.trust for c in self.code], axis=1)
        near = np.sort(loss, axis=1)
        odds = np.exp(-6 * (loss - near[:, :1]))
        score = 1 / odds.sum(axis=1)
        second = near[:, 1] - near[:, 0] if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[i] for i in loss.argmin(axis=1)], score, second < MARGIN


def has_letter(text: str | None) -> bool:
    if not isinstance(text, str):
        return False
    return any(c.isalpha() for c in text)


def learn(docs: DataFrame, per_lang: int = PER_LANG, total: int = TOTAL) -> Decoder:
    """A decoder from a bounded sample of rows with text, lang and doc_id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Decoder([], np.ones((0, 1)), np.zeros((DIM, 1), np.float32), np.ones(1), np.ones(1))
    want = max(1, min(per_lang, total // len(counts)))
    # Twice the rows wanted of each language, by hash; then exactly so many.
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 32))
    share = F.lit(json.dumps({lang: int(min(1.0, (2 * want + 20) / n) * (1 << 32)) for lang, n in counts.items()}))
    limit = F.element_at(F.from_json(share, "map<string,bigint>"), F.col("lang"))
    held = rows.select("lang", "text", "doc_id", place.alias("place")).where(F.col("place") < limit)
    # Which rows to learn from is known from their sizes alone, so that few bytes come to the driver.
    key = F.xxhash64("text")
    sizes = held.select("lang", "place", "doc_id", F.octet_length("text").alias("size"), key.alias("key")).toPandas()
    sizes = sizes.sort_values(["lang", "place", "doc_id", "key"], kind="stable").groupby("lang").head(want)
    sizes["upto"] = sizes.groupby("lang")["size"].cumsum()
    sizes = sizes[sizes["upto"] - sizes["size"] < BYTES // len(counts)]
    if not len(sizes):
        return Decoder.fit([], [])
    top = {lang: int(p) for lang, p in sizes.groupby("lang")["place"].max().items()}
    got = held.where(F.col("place") <= F.element_at(F.from_json(F.lit(json.dumps(top)), "map<string,bigint>"), F.col("lang"))).withColumn("key", key).toPandas()
    got = got.sort_values(["lang", "place", "doc_id", "key"], kind="stable").groupby("lang").head(want)
    return Decoder.fit([vec.encode(t) for t in got["text"]], list(got["lang"]))


def identify(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row; docs has held_out."""
    held = docs.sparkSession.sparkContext.broadcast(decoder)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        d = held.value
        for column in batches:
            lang, score, near = np.full(len(column), "und", dtype=object), np.zeros(len(column)), np.zeros(len(column), bool)
            if d.langs:
                for first, texts in vec.blocks(column):
                    at = slice(first, first + len(texts))
                    lang[at], score[at], near[at] = d.predict(texts)
                silent = ~column.map(has_letter).to_numpy(dtype=bool)
                lang[silent], score[silent], near[silent] = "und", 0.0, False
            yield pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": near})

    return docs.select("doc_id", "held_out", F.pandas_udf(predict, _SCHEMA)("text").alias("p")).select("doc_id", "held_out", "p.*")


def report(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.withColumn("held_out", fold)
    return identify(rows, learn(rows.where(~F.col("held_out"))))
