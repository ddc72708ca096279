"""Queries against their SQL at the smallest size, and that they all run."""

import os

import duckdb
import pytest

from palimpsest import catalog

CHECKED = ["t1_tokenize", "t2_expand_word", "t3_split_identifier", "t5_path_terms", "a1_postings", "a2_terms", "search_bm25", "r6_dense_top10", "r8_rrf", "r14_explain", "e1_rm3", "e5_e6_e7_difficulty", "v1_evaluate", "i1_plan_work", "i1_streaming_ingest", "x9_dice", "p11_snippet"]


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    have = sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    got = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert have == want


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
