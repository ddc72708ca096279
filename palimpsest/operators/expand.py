"""Query expansion, query difficulty and spelling, over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import search
from palimpsest.operators.index import Index


def rm3(index: Index, queries: DataFrame, hits: DataFrame, fb_docs: int = 3, fb_terms: int = 10, alpha: float = 0.5) -> DataFrame:
    """(qid, term, weight, repeats): the query's tokens mixed with the best terms of its first hits."""
    counts = hits.where(F.col("rank") < fb_docs).select("qid", "doc_id").join(index.postings, "doc_id").groupBy("qid", "term").agg(F.sum("tf").alias("tf"))
    share = F.col("tf") / F.sum("tf").over(W.partitionBy("qid"))
    best = counts.withColumn("p", share).withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("p"), "term"))).where(F.col("r") <= fb_terms)
    tokens = search.query_tokens(queries)
    own = tokens.join(tokens.groupBy("qid").agg(F.count(F.lit(1)).alias("m")), "qid").select("qid", F.col("qtoken").alias("term"), (F.lit(alpha) / F.col("m")).alias("w"))
    both = own.unionByName(best.select("qid", "term", (F.col("p") * (1 - alpha)).alias("w")))
    out = both.groupBy("qid", "term").agg(F.sum("w").alias("weight"))
    return out.withColumn("repeats", F.greatest(F.lit(1), F.floor(F.col("weight") * 10 + 1e-9)).cast("long"))


def rocchio(index: Index, queries: DataFrame, relevant: DataFrame, other: DataFrame, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, most: int = 10) -> DataFrame:
    """(qid, term, weight): query tokens plus the best terms that relevant documents have and others lack.

    relevant and other are (qid, doc_id).
    """

    def mean(docs: DataFrame, factor: float) -> DataFrame:
        n = docs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        return docs.join(index.postings, "doc_id").join(n, "qid").select("qid", "term", (F.col("tf") * factor / F.col("n")).alias("w"))

    terms = mean(relevant, beta).unionByName(mean(other, -gamma)).groupBy("qid", "term").agg(F.sum("w").alias("w")).where(F.col("w") > 0)
    best = terms.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("w", 9)), "term"))).where(F.col("r") <= most)
    own = search.query_tokens(queries).select("qid", F.col("qtoken").alias("term"), F.lit(alpha).alias("w"))
    return own.unionByName(best.select("qid", "term", "w")).groupBy("qid", "term").agg(F.sum("w").alias("weight"))


def difficulty(index: Index, queries: DataFrame, hard_below: float = 2.0) -> DataFrame:
    """Predictors for each query, from its distinct tokens that are indexed.

    avg_idf, max_idf, scope (share of documents with any token), scq, clarity, and
    is_hard: the mean idf is low.
    """
    tokens = search.query_tokens(queries)
    one = F.broadcast(index.coll.select("n", "total"))  # one row
    known = tokens.withColumnRenamed("qtoken", "term").join(index.terms, "term").crossJoin(one)
    idf = search.idf(F.col("n"), F.col("df"))
    by = known.groupBy("qid").agg(F.avg(idf).alias("avg_idf"), F.max(idf).alias("max_idf"), F.avg(idf * F.log(1 + F.col("cf"))).alias("scq"))
    scope = known.select("qid", "term", "n").join(index.postings.select("term", "doc_id"), "term").groupBy("qid", "n").agg(F.countDistinct("doc_id").alias("docs"))
    scope = scope.select("qid", (F.col("docs") / F.col("n")).alias("scope"))
    said = queries.select("qid", F.explode(T.tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy("qid"))
    lm = said.withColumn("p", p).join(index.terms.select("term", "cf"), "term", "left").crossJoin(one)
    clarity = lm.groupBy("qid").agg(F.sum(F.col("p") * F.log(F.col("p") / F.coalesce(F.col("cf") / F.col("total"), F.lit(1e-12)))).alias("clarity"))
    out = queries.select("qid").join(by, "qid", "left").join(scope, "qid", "left").join(clarity, "qid", "left")
    return out.fillna(0.0).withColumn("is_hard", F.col("avg_idf") < hard_below)


def fuzzy_terms(index: Index, tokens: DataFrame, fuzziness: int = 1, most: int = 50, prefix: int = 1) -> DataFrame:
    """(qtoken, term, distance): indexed terms within so many edits, nearest first, then by term.

    Terms are compared within blocks of one first letter and near lengths; the
    distance counts a swap of neighbours as one edit.
    """
    from palimpsest.functions.udfs import osa

    t = index.terms.select("term", F.substring("term", 1, prefix).alias("start"), F.length("term").alias("n"))
    q = tokens.select("qtoken").distinct().select("qtoken", F.substring("qtoken", 1, prefix).alias("start"), F.explode(F.sequence(F.length("qtoken") - fuzziness, F.length("qtoken") + fuzziness)).alias("n"))
    # Plain edit distance with a bound first: a swap costs two there.
    near = q.join(t, ["start", "n"]).where((F.col("term") != F.col("qtoken")) & (F.levenshtein("qtoken", "term", 2 * fuzziness) >= 0))
    scored = near.withColumn("distance", osa("qtoken", "term")).where(F.col("distance") <= fuzziness)
    rank = F.row_number().over(W.partitionBy("qtoken").orderBy("distance", "term"))
    return scored.withColumn("r", rank).where(F.col("r") <= most).select("qtoken", "term", "distance")


def delete_lookup(index: Index, tokens: DataFrame) -> DataFrame:
    """(qtoken, term): terms that share a string with a token once up to one letter is left out of each."""
    side = lambda df, c: df.select(c, F.explode(T.deletes(F.col(c), 1)).alias("d"))
    return side(tokens.select("qtoken").distinct(), "qtoken").join(side(index.terms.select("term"), "term"), "d").select("qtoken", "term").distinct()


def spell(index: Index, words: DataFrame) -> DataFrame:
    """(word, corrected): itself if indexed, else the most frequent term within two edits, ties by term."""
    known = words.select("word").distinct().join(index.terms.select(F.col("term").alias("word"), "cf"), "word", "left")
    lost = known.where(F.col("cf").isNull()).select(F.col("word").alias("qtoken"))
    near = fuzzy_terms(index, lost, 2, most=1 << 30, prefix=1).join(index.terms.select("term", "cf"), "term")
    best = near.groupBy("qtoken").agg(F.min(F.struct((-F.col("cf")).alias("c"), "term")).alias("b"))
    return known.join(best, known.word == best.qtoken, "left").select("word", F.coalesce("b.term", "word").alias("corrected"))
