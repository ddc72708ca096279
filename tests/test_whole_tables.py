"""Queries that cover whole tables and whole texts, on a small table with ids over 200."""

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import text as T
from palimpsest.operators import lsh


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """230 documents: numbers 0 to 9 as words; ids 220 and 225 hold equal long texts."""
    at = str(tmp_path_factory.mktemp("small"))
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"item {i} shelf{i % 10} place{i // 2}", "en", f"src{i % 3}", 30) for i in range(230)]
    for i, n in ((220, 2390), (225, None)):
        rows[i] = (i, long, "en", "src1", n)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    start = "the first sixty characters of both of these passages are equal "
    spark.createDataFrame([(1, start + "and end here"), (2, start + "but go on otherwise")], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def test_simhash_classes_include_long_texts(spark, small):
    h = {r.doc_id: r.h for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", T.simhash(F.split("text", r"\s+")).alias("h")).collect()}
    first = {x: min(i for i in h if h[i] == x) for x in h.values()}
    near = {x: sum(x != y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3 for y in first) for x in first}
    got = {r.doc_id: (r.class_id, r.n_links) for r in catalog.queries()["x19_simhash_lsh"](spark, small).collect()}
    assert got == {i: (first[x], near[x]) for i, x in h.items()} and got[225][0] == 220
    pairs = {(r.a, r.b, r.distance) for r in lsh.near_signatures(spark.createDataFrame(list(h.items()), "doc_id long, h long")).collect()}
    assert pairs == {(x, y, ((x ^ y) & (1 << 64) - 1).bit_count()) for x in first for y in first if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}


def test_minhash_signs_whole_passages(spark, small):
    sig = {r.item_id: r.sig.split(",") for r in catalog.queries()["x20_minhash"](spark, small).collect()}
    assert len(sig[1]) == len(sig[2]) == 128 and sig[1] != sig[2]


def test_sparse_cosine_and_stores_cover_all_documents(spark, small):
    run = lambda name: catalog.queries()[name](spark, small)
    assert {r.doc_id for r in run("x13_sparse_cosine").collect()} == set(range(229))
    pages = {r.source for r in run("s5_corpus_store").collect()}
    assert len(pages) == 230 and {r.source for r in run("s6_corpus_chunks").collect()} == pages


def test_term_functions_see_frequent_terms(spark, small):
    from palimpsest.plans.base import doc_index

    terms = {r.term: r.df for r in doc_index(spark, small).terms.collect()}
    assert terms["shelf3"] > 3
    for name in ("x1_osa", "x8_jaro_winkler", "x15_metaphone", "x16_porter"):
        assert {r.term for r in catalog.queries()[name](spark, small).collect()} == set(terms)
