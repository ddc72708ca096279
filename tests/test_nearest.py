"""Exact nearest vectors, against brute force."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import text as T
from palimpsest.operators import fusion, nearest

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0], [NAN, 1.0, 1.0], [INF, 1.0, 0.0], [-INF, 2.0, 0.0], [1.0, None, 2.0], [0.0, 0.0, 0.0], [1e300, 1e300, -1e300], [-0.0, -1.0, 3.0]]
QIDS = "qid long, embedding array<double>"
IDS = "doc_id long, embedding array<double>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listed(df):
    return sorted((r.qid, r["rank"], r.doc_id is None, r.doc_id, repr(r.score)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4, 30, 1 << 30])
def test_odd_vectors_rank_as_by_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(nearest, "VECTORS", 7)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    rows = [(i, x) for i, x in enumerate(ODD)] + [(20 + i, [float(i % 3), 0.1 * (i % 4), 0.7]) for i in range(24)] + [(None, [2.0, 0.3, 0.7])]
    v = spark.createDataFrame(rows, IDS).coalesce(1)
    q = spark.createDataFrame([(i, x) for i, x in rows if i is not None and i % 3 == 0 or i in range(8)], QIDS)
    pairs = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("qid", "doc_id", T.dot(F.col("embedding"), F.col("q")).alias("score"))
    assert listed(nearest.by_dot(v, q, k)) == listed(fusion.ranked(pairs, k))


def _brute(v, q, k):
    out = []
    for i, x in enumerate(q):
        s = [0.0] * len(v)
        for j, y in enumerate(v):
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                s[j] += a * b
        out += [(i, j, s[j]) for j in sorted(range(len(v)), key=lambda j: (-s[j], j))[:k]]
    return out


@pytest.mark.parametrize("copies", [1, 3, 200])
def test_blocks_keep_equal_and_near_equal_scores_in_order(monkeypatch, copies):
    monkeypatch.setattr(nearest, "_V", 32)
    monkeypatch.setattr(nearest, "_Q", 3)
    monkeypatch.setattr(nearest, "_PAIRS", 5)
    rng = np.random.default_rng(copies)
    v = np.repeat(rng.normal(size=(600 // copies, 16)), copies, axis=0)
    v[::7] = v[0][rng.permutation(16)] if copies == 1 else v[0]
    v[1::7] = v[::7][: len(v[1::7])] * (1 + 2.0**-52)  # a last bit apart
    q = rng.normal(size=(8, 16))
    order = rng.permutation(len(v))
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    got = nearest.best_of_cell(pa.table({"doc_id": order, "embedding": lists(v[order])}), pa.table({"qid": np.arange(8), "embedding": lists(q)}), 20)
    assert sorted(map(tuple, got.select(["qid", "doc_id", "score"]).to_pandas().to_numpy().tolist())) == sorted(_brute(v, q, 20))


def _cell(v, q, k):
    lists = lambda x: pa.array(list(x), pa.list_(pa.float32()))
    got = nearest.best_of_cell(pa.table({"doc_id": np.arange(len(v)), "embedding": lists(v)}), pa.table({"qid": np.arange(len(q)), "embedding": lists(q)}), k)
    return [(i, j, repr(s)) for i, j, s in zip(*(got[c].to_pylist() for c in ("qid", "doc_id", "score")), strict=True)]


@pytest.mark.parametrize("k", [1, 20, 150, 1 << 30])
@pytest.mark.parametrize("near", [1 << 20, 1500])
def test_single_precision_of_any_length_ranks_as_by_brute_force(monkeypatch, k, near):
    monkeypatch.setattr(nearest, "_NEAR", near)
    rng = np.random.default_rng(k)
    v = rng.normal(size=(701, 12)) * 10.0 ** rng.integers(-40, 38, 701)[:, None]
    v[200:], v[::9] = rng.normal(size=(501, 12)), v[300]  # lengths alike, and equal vectors
    v[1::9] = v[300] * (1 + 2.0**-23)
    v[5], v[6], v[7, 3], v[8, 2] = 3e38, 0, NAN, INF
    q = np.concatenate([v[[5, 6, 7, 8, 20, 150, 300, 420]], rng.normal(size=(3, 12)), 1e-45 * np.ones((1, 12))])
    with np.errstate(over="ignore"):
        v, q = v.astype("float32"), q.astype("float32")
    want = []
    for i, x in enumerate(q.astype("float64")):
        s = np.zeros(len(v))
        with np.errstate(all="ignore"):
            for a, b in zip(x, v.T.astype("float64"), strict=True):
                s += a * b
        want += [(i, j, repr(float(s[j]))) for j in sorted(range(len(v)), key=lambda j: (not np.isnan(s[j]), -s[j], j))[:k]]
    assert sorted(_cell(v, q, k)) == sorted(want)


def test_one_long_vector_does_not_have_all_pairs_scored(monkeypatch):
    scored, scores = [], nearest._scores
    monkeypatch.setattr(nearest, "_scores", lambda q, a, i, j: scored.append(len(i)) or scores(q, a, i, j))
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(4097, 16)), rng.normal(size=(64, 16))
    v[7] = 1e15
    assert len(_cell(v, q, 10)) == 640
    assert sum(scored) < 4 * 640


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    """1400 vectors: equal ones, and one without an id that ties with others."""
    at = str(tmp_path_factory.mktemp("vectors"))
    duckdb.execute(f"copy (select case when i <> 77 then i end vec_id, list_transform(range(8), lambda j: (hash(i % 200, j) % 1000)::float / 999) embedding, 0 as label from range(1400) t(i)) to '{at}/embeddings.parquet'")
    return at


def _sql(vectors, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{vectors}/embeddings.parquet'")
    return sorted(con.execute(catalog.oracle_sql()[name]).fetchall(), key=str)


def test_w1_ranks_equals_sql_without_rows_for_pairs(spark, vectors):
    got = catalog.queries()["w1_ranks"](spark, vectors)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == _sql(vectors, "w1_ranks")


def test_r6_dense_top10_equals_sql_without_rows_for_pairs(spark, vectors):
    got = catalog.queries()["r6_dense_top10"](spark, vectors)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert sorted(map(tuple, got.select("qid", "doc_id", "score", "rank").collect()), key=str) == _sql(vectors, "r6_dense_top10")


def test_r6_dense_top10_keeps_ten_of_each_query_and_no_cache(spark, vectors):
    p = plan(catalog.queries()["r6_dense_top10"](spark, vectors))
    assert "InMemoryTableScan" not in p
    assert set(re.findall(r"WindowGroupLimit.*, (\d+), (?:Partial|Final)", p)) == {"10"}
