"""Suffix-array dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import suffix_dedup as sd
from tests.llm.test_native import frame, odd


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone[-1] = False
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("lane", [1, 7, 256])
def test_suffix_array_and_common_prefixes(lane):
    rng = np.random.default_rng(lane)
    for trial in range(40):
        buf = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(2, 300)).astype(np.uint8)
        buf = np.tile(buf[:20], 9) if trial % 4 == 0 else buf
        order, raw = sd.suffix_array(buf), buf.tobytes()
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = sd.common_prefixes(buf, order, 30, lane)
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((x for x in range(30) if raw[order[k - 1] + x : order[k - 1] + x + 1] != raw[order[k] + x : order[k] + x + 1] or x >= min(len(a), len(b))), 30)
            assert lcp[k] == same


def test_merge_finds_digests_of_several_shards():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 1, 40, 90, 120, 3)]
    want = sorted(k for k, c in Counter(x for p in parts for x in p.tolist()).items() if c > 1)
    assert sd.merged([(p, p.astype(np.uint32)) for p in parts])[0].tolist() == want


def test_suffix_dedup_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(sd.report(docs, shard=1 << 15)) == brute([(r.doc_id, r.text) for r in docs.collect()], sd.LENGTH)


def test_suffix_dedup_of_hard_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    a, b = word(260), word(199)
    texts = [word(50) + a + word(30), a, word(9) + a[:200], b + "x", b + "y", "ab" * 400, word(500) + "ab" * 90 + a[60:] + b, "é" * 300, a + a, "", None, "x" * 199, "x" * 199, "x" * 200, "x" * 200]
    for shard in (300, 1 << 20):
        assert result(sd.report(frame(spark, texts), shard=shard)) == brute(list(enumerate(texts)), 200)
    rows = odd(spark)
    assert result(sd.report(rows.limit(0))) == []
    got = result(sd.report(rows))
    assert got == brute([(r.doc_id, r.text) for r in rows.collect()], 200)
