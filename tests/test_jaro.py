"""Jaro similarity against DuckDB."""

import random

import duckdb

from palimpsest import catalog
from palimpsest.functions import udfs


def test_jaro_equals_duckdb():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef"[: rng.choice([1, 2, 3, 6])], k=rng.randint(1, rng.choice([1, 3, 9, 90]))))
    pairs = [("A", "A"), ("A", "B"), ("", "A"), ("Ention", "Thonater"), ("Erhein", "Tioneren"), *((word(), word()) for _ in range(500))]
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    for a, b, v in duckdb.execute(f"select a, b, jaro_similarity(a, b) from (values {values}) t(a, b)").fetchall():
        assert abs(udfs.jaro_of(a, b) - v) < 1e-12, (a, b)


def test_x7_equals_sql_on_odd_rows(spark, tmp_path):
    texts = ["A one", "A two", "Ention three", "Thonater four", None, "", " x", "Erhein", "Tioneren\n five", "Tioneren five", "naïve six", "B,. C", "B.", "a1 b", "A"]
    rows = ", ".join(f"({i}, {'null' if x is None else repr(x) if chr(10) not in x else repr(x).replace(chr(92) + 'n', chr(10))})" for i, x in enumerate(texts))
    con = duckdb.connect()
    con.execute(f"create table benchmark as select item_id::bigint item_id, text from (values {rows}, (null, 'A'), (3, 'Thonater again')) t(item_id, text)")
    con.execute(f"copy benchmark to '{tmp_path}/benchmark.parquet'")
    want = con.execute(catalog.oracle_sql()["x7_jaro"]).fetchall()
    got = catalog.queries()["x7_jaro"](spark, str(tmp_path)).select("a_id", "b_id", "v").collect()
    assert sorted(map(tuple, got)) == sorted(want) and (0, 1, 1.0) in want
