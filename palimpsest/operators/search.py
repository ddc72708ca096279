"""Batched search: queries are a DataFrame (qid, query), results (qid, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import fusion, nearest
from palimpsest.operators.index import Index

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_tokens(queries: DataFrame, strip_trailing_dot: bool = False) -> DataFrame:
    """(qid, qtoken): the distinct tokens of each query."""
    return queries.select("qid", F.explode(F.array_distinct(T.tokenize(F.col("query"), strip_trailing_dot))).alias("qtoken"))


def bm25(index: Index, queries: DataFrame, k: int = 200, min_should_match: float = 0.6, expansions: DataFrame | None = None, candidates: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of all queries in one plan.

    A document qualifies if it holds at least the given share of a query's
    distinct tokens. expansions (qtoken, term) adds terms that count for a token at
    full weight; candidates (qid, doc_id) restricts the documents but not df.
    """
    tokens = query_tokens(queries)
    need = tokens.groupBy("qid").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * min_should_match)).alias("need"))
    terms = tokens.withColumn("term", F.col("qtoken"))
    if expansions is not None:
        terms = terms.unionByName(tokens.join(expansions, "qtoken").select("qid", "qtoken", "term")).distinct()
    known = terms.join(index.terms.select("term", "df"), "term")
    # Queries of which too few tokens are indexed find nothing.
    able = known.groupBy("qid").agg(F.countDistinct("qtoken").alias("have")).join(need, "qid").where(F.col("have") >= F.col("need")).select("qid", "need")
    weighed = known.join(able, "qid").crossJoin(F.broadcast(index.coll.select("n", "avgdl")))  # one row
    weighed = weighed.select("qid", "qtoken", "term", "need", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    hits = index.postings.join(weighed, "term")
    if candidates is not None:
        hits = hits.join(candidates.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    hits = hits.join(index.doc_stats, "doc_id")
    part = F.col("idf") * (k1 + 1) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    if expansions is None:  # a term is a token, and is there once
        sums = hits.groupBy("qid", "doc_id", "need").agg(F.round(F.sum(part), 9).alias("score"), F.count(F.lit(1)).alias("matched"))
        return fusion.ranked(sums.where(F.col("matched") >= F.col("need")).select("qid", "doc_id", "score"), k)
    # A term that several tokens expand to counts once; what qualifies is counted by token.
    once = hits.groupBy("qid", "doc_id", "term", "need").agg(F.first(part).alias("part"), F.collect_set("qtoken").alias("tokens"))
    sums = once.groupBy("qid", "doc_id", "need").agg(F.round(F.sum("part"), 9).alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("matched"))
    return fusion.ranked(sums.where(F.col("matched") >= F.col("need")).select("qid", "doc_id", "score"), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 200) -> DataFrame:
    """Exact top k by dot product; vectors (doc_id, embedding), queries (qid, embedding)."""
    return nearest.by_dot(vectors, queries, k)


def search(index: Index, queries: DataFrame, mode: str = "bm25", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 8, bm25_k: int = 200, dense_k: int = 200, rrf_k: int = 60, per_file: int | None = 1, min_should_match: float = 0.6, reranker=None) -> DataFrame:
    """Ranked hits (qid, rank, doc_id, source, score) of all queries.

    hybrid without vectors is plain BM25. reranker(pairs) gets (qid, query, doc_id,
    text) of the first max(5 k, 50) hits and returns (qid, doc_id, rerank_score).
    """
    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    have = vectors is not None and query_vectors is not None
    if mode == "dense" and not have:
        raise ValueError("dense search needs vectors of documents and queries")
    lists = [] if mode == "dense" else [bm25(index, queries, bm25_k, min_should_match)]
    if mode != "bm25" and have:
        lists.append(dense(vectors, query_vectors, dense_k))
    found = lists[0] if len(lists) == 1 else fusion.rrf(lists, rrf_k)
    hits = fusion.per_source(found.join(index.docs.select("doc_id", "source"), "doc_id"), per_file)
    if reranker is not None:
        pool = max(5 * k, 50)
        head = hits.where(F.col("rank") < pool)
        pairs = head.join(queries, "qid").join(index.docs.select("doc_id", "text"), "doc_id").select("qid", "query", "doc_id", "text")
        order = W.partitionBy("qid").orderBy(F.col("rerank_score").isNull(), F.desc("rerank_score"), "rank")
        hits = hits.join(reranker(pairs), ["qid", "doc_id"], "left").withColumn("rank", F.row_number().over(order) - 1)
    return hits.where(F.col("rank") < k)


def explain(index: Index, queries: DataFrame, lexical: DataFrame, semantic: DataFrame | None = None, rrf_k: int = 60) -> DataFrame:
    """Score and rank of each hit in both lists, and its fused score."""
    part = lambda r: F.coalesce(1.0 / (F.col(r) + rrf_k), F.lit(0.0))
    a = lexical.select("qid", "doc_id", F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    if semantic is None:
        return a.withColumns({"dense": F.lit(None).cast("double"), "dense_rank": F.lit(None).cast("int")}).withColumn("rrf", part("bm25_rank"))
    b = semantic.select("qid", "doc_id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
    return a.join(b, ["qid", "doc_id"], "full_outer").withColumn("rrf", part("bm25_rank") + part("dense_rank"))


def term_report(index: Index, queries: DataFrame, most: int = 12) -> DataFrame:
    """(qid, term, df) of the first tokens of each query; df 0 if not indexed."""
    tokens = queries.select("qid", F.posexplode(F.slice(F.array_distinct(T.tokenize(F.col("query"))), 1, most)).alias("at", "term"))
    return tokens.join(index.terms.select("term", "df"), "term", "left").select("qid", "at", "term", F.coalesce("df", F.lit(0)).alias("df"))


def below(docs: DataFrame, dirs: tuple[str, ...]) -> DataFrame:
    """The documents whose source begins with one of the folders."""
    return docs.where(_any([F.col("source").startswith(d) for d in dirs])) if dirs else docs


def mentions(docs: DataFrame, term: str, limit: int = 60, context: int = 0, dirs: tuple[str, ...] | None = None, ignore_case: bool = True) -> DataFrame:
    """(source, count, context): literal occurrences by source, most first."""
    if not term:
        raise ValueError("the term is empty")
    docs = below(docs, dirs or ())
    fold = F.lower if ignore_case else (lambda x: x)
    hay, needle = fold(F.coalesce("text", F.lit(""))), F.lit(term.lower() if ignore_case else term)
    n = ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / len(term)).cast("long")
    at = F.call_function("locate", needle, hay)
    lo = F.greatest(at - context, F.lit(1))
    around = F.regexp_replace(F.substring("text", lo, at + len(term) + context - lo), r"\s+", " ")
    found = docs.select("source", "doc_id", n.alias("n"), (around if context else F.lit(None).cast("string")).alias("around")).where(F.col("n") > 0)
    return found.groupBy("source").agg(F.sum("n").alias("count"), F.min_by("around", "doc_id").alias("context")).orderBy(F.desc("count"), F.desc("source")).limit(limit)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def neighbours(hits: DataFrame, chunks: DataFrame, n: int = 1) -> DataFrame:
    """Chunks of the same page up to n places from each hit, itself left out."""
    c = chunks.select("source", F.col("pos").alias("n_pos"), F.col("text").alias("n_text"))
    near = hits.select("qid", "doc_id", "source", "pos").withColumn("n_pos", F.explode(F.sequence(F.col("pos") - n, F.col("pos") + n)))
    return near.where(F.col("n_pos") != F.col("pos")).join(c, ["source", "n_pos"])


def first_sources(hits: DataFrame, n: int) -> DataFrame:
    """(qid, source, place): the first n different sources of each query's hits."""
    seen = hits.groupBy("qid", "source").agg(F.min("rank").alias("first_rank"))
    return seen.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("first_rank")) - 1).where(F.col("place") < n)


def to_markdown(hits: DataFrame, queries: DataFrame, report: DataFrame | None = None, bm25_only: bool = False) -> DataFrame:
    """(qid, markdown): a block for each query: a heading, its hits, and which of its terms are indexed.

    hits is (qid, rank from 0, title, source, score, snippet); bm25_only marks searches
    that were to use vectors but had none; report is term_report().
    """
    one_line = F.regexp_replace(T.strip(F.coalesce("snippet", F.lit(""))), r"\s+", " ")
    line = F.concat(
        (F.col("rank") + 1).cast("string"), F.lit(". **"), F.col("title"), F.lit("** `"), F.col("source"), F.lit("` score="), F.format_string("%.4f", "score"),
        F.lit("\n  > "), one_line, F.lit("\n  read: "), F.col("source"),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line), "\n")
    out = queries.join(hits.groupBy("qid").agg(lines.alias("lines")), "qid", "left")
    head = F.concat(F.lit("### "), F.col("query"), F.lit(" (bm25-only)" if bm25_only else ""), F.lit("\n"), F.coalesce("lines", F.lit("no results")))
    if report is None:
        return out.select("qid", head.alias("markdown"))
    known = F.array_sort(F.collect_list(F.when(F.col("df") > 0, F.struct("at", "term"))))
    terms = report.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.transform(known, lambda x: x.term).alias("known"))
    tail = F.concat(F.lit("\nterms in index: "), F.size("known").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" ["), F.array_join("known", ", "), F.lit("]"))
    return out.join(terms, "qid", "left").select("qid", F.concat(head, F.coalesce(tail, F.lit(""))).alias("markdown"))


def mentions_to_markdown(term: str, rows: list) -> str:
    """mentions() as a list, one line a source."""
    of = lambda r: f" — {r['context']}" if r["context"] else ""
    return "\n".join([f"### mentions: {term} ({len(rows)} files)", *[f"- `{r['source']}` ×{r['count']}{of(r)}" for r in rows]])
