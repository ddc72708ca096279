"""Gold sets, rankers and the checks that compare them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluation, fusion, search
from palimpsest.operators.index import Index

# Phrases of questions that only make sense beside their page.
BANNED = ("this page", "the text", "according to")
Ranker = Callable[[DataFrame], DataFrame]


def is_question(text: Column, banned: tuple[str, ...] = BANNED) -> Column:
    """A question that can stand alone: 25 to 139 characters, ends with ?, no banned phrase."""
    return F.length(text).between(25, 139) & text.endswith("?") & ~F.lower(text).rlike("|".join(banned))


def load(sets: dict[str, DataFrame], which: str = "all") -> DataFrame:
    """(qid, query, gold, set_name) of one named set, or of all."""
    if which != "all" and which not in sets:
        raise ValueError(f"unknown gold set {which!r}, not one of {sorted(sets)}")
    rows = [df.select("qid", "query", "gold", F.lit(name).alias("set_name")) for name, df in sets.items() if which in ("all", name)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def extend(questions: DataFrame, n: int = 16, seed: int = 13, capped: str = "a") -> DataFrame:
    """(qid, query, kind): n questions in a seeded order.

    One for each prefix of five words, and half of them of the capped kind at most.
    questions is (qid, query, kind).
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("qid").cast("string")))
    rows = questions.withColumn("place", place).withColumn("prefix", F.array_join(F.slice(F.split(F.lower("query"), " "), 1, 5), " "))
    first = rows.groupBy("prefix").agg(F.min(F.struct("place", "qid", "query", "kind")).alias("r")).select("r.*")
    # The first n of each side are enough, so that no window holds a whole kind.
    side = lambda cond, most: first.where(cond).orderBy("place", "qid").limit(most)
    return side(F.col("kind") == capped, n // 2).unionByName(side(F.col("kind") != capped, n)).orderBy("place", "qid").limit(n).select("qid", "query", "kind")


def engine_ranker(index: Index, **knobs) -> Ranker:
    """Queries to hits (qid, rank, doc_id, source, score) by search.search()."""
    return lambda queries: search.search(index, queries, **knobs)


def table_ranker(hits: DataFrame, k: int) -> Ranker:
    """Queries to the first k of hits that a table has."""
    return lambda queries: hits.join(queries.select("qid"), "qid", "left_semi").where(F.col("rank") < k)


def compare(rankers: dict[str, Ranker], queries: DataFrame, gold: DataFrame) -> DataFrame:
    """evaluate() of several rankers, an arm each, in one plan."""
    arms = [r(queries).select(F.lit(name).alias("arm"), "qid", "rank", "source") for name, r in rankers.items()]
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return evaluation.evaluate(out, gold)


def regression(before: DataFrame, after: DataFrame, gold: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(arm, mrr, displaced): two lists' MRR, and how many of the first k documents differ on average."""
    named = lambda x: x.where(F.col("rank") < k).join(docs.select("doc_id", "source"), "doc_id")
    scores = compare({"before": lambda q: named(before), "after": lambda q: named(after)}, gold.select("qid"), gold).select("arm", "mrr")
    moved = evaluation.displacement(before, after, k).agg(F.round(F.avg("displaced"), 6).alias("displaced"))
    return scores.join(F.broadcast(moved), F.lit(True))  # one row


def rescued(lexical: DataFrame, semantic: DataFrame, gold: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(qid): queries whose gold the second list has among its first k, and the first list hasn't."""
    found = lambda x: evaluation.relevance(x.where(F.col("rank") < k).join(docs.select("doc_id", "source"), "doc_id").withColumn("arm", F.lit("")), gold).select("qid").distinct()
    return found(semantic).join(found(lexical), "qid", "left_anti")


def with_typo(query: Column) -> Column:
    """The query with the second and third letter of its longest word, the first of these, swapped."""
    words = F.split(query, " ")
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    at = F.array_position(F.transform(words, lambda w: F.length(w)), longest) - 1
    swapped = lambda w: F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, 4, 1 << 30))
    return F.when(longest >= 3, F.array_join(F.transform(words, lambda w, i: F.when(i == at, swapped(w)).otherwise(w)), " ")).otherwise(query)


def verify(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, n_docs): how many documents hold each needle. gold is (qid, passage); 0 means a bad needle."""
    found = evaluation.containing(docs, gold).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return gold.join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"))


def smoke(index: Index, vectors_meta: dict | None = None) -> DataFrame:
    """(check, ok): what any index must fulfil."""
    lost = index.postings.join(index.doc_stats, "doc_id", "left_anti").limit(1).count()
    unknown = index.postings.join(index.terms, "term", "left_anti").limit(1).count()
    sums = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(index.terms, "term").where("n <> df").limit(1).count()
    said = {"has documents": index.doc_stats.limit(1).count() == 1, "has terms": index.terms.limit(1).count() == 1, "postings have documents": lost == 0, "postings have terms": unknown == 0, "df counts postings": sums == 0}
    if vectors_meta is not None:
        said["a vector for each document"] = vectors_meta["complete"] and vectors_meta["count"] == index.doc_stats.count()
    return index.docs.sparkSession.createDataFrame(sorted(said.items()), "check string, ok boolean")


def corpus_quality(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: chunks a page, the share of chunks with a summary or keywords, and chunks that aren't in their page.

    chunks is (source, text, summary, keywords), pages (source, markdown).
    """
    aux = (F.coalesce("summary", F.lit("")) != "") | (F.coalesce(F.size("keywords"), F.lit(0)) > 0)
    within = F.contains(T.norm_verbatim(F.col("markdown")), T.norm_verbatim(F.col("text")))
    rows = chunks.join(pages.select("source", "markdown"), "source")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("pages"), F.avg(F.when(aux, 1.0).otherwise(0.0)).alias("aux"), F.count_if(~within).alias("violations"))
    return out.select(F.round(F.col("n") / F.col("pages"), 6).alias("chunks_per_page"), F.round("aux", 6).alias("aux_share"), "violations")


#: Named ways to combine two lists: (how, fusion's parameter, hits of a source).
CONFIGS = {
    "first": ("first", 0.0, 1),
    "first-all": ("first", 0.0, 0),
    "second": ("second", 0.0, 1),
    "rrf": ("rrf", 60, 1),
    "rrf-all": ("rrf", 60, 0),
    "linear": ("linear", 0.7, 1),
    "linear-all": ("linear", 0.7, 0),
}


def combined(how: str, value: float, per_source: int, first: DataFrame, second: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their source by one of CONFIGS."""
    ranked = {"first": lambda: first, "second": lambda: second, "rrf": lambda: fusion.rrf([first, second], int(value)), "linear": lambda: fusion.linear(first, second, value)}[how]()
    return fusion.per_source(ranked.select("qid", "doc_id", "score", "rank").join(docs.select("doc_id", "source"), "doc_id"), per_source)


def sweep(first: DataFrame, second: DataFrame, docs: DataFrame, gold: DataFrame, configs: dict = CONFIGS, k: int = 10) -> DataFrame:
    """evaluate() of each configuration."""
    arms = {name: (lambda q, c=c: combined(*c, first, second, docs).where(F.col("rank") < k)) for name, c in configs.items()}
    return compare(arms, gold.select("qid"), gold)
