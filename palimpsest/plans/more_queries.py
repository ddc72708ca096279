"""Queries of single joins, aggregates, windows, orders and sweeps (A, J, W, K, U, P, V)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluation, fusion, incremental, index, lsh, positions, search
from palimpsest.plans.base import BM25, INDEX, bench_queries, bm25_hits, doc_index, table, with_
from palimpsest.plans.search_queries import _DEDUP, _EVAL, _NOW, _OTHER, _dense, _gold, _other, _snapshots, _VEC

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _terms_of(s, d):
    return search.query_tokens(bench_queries(s, d)).withColumnRenamed("qtoken", "term")


@query("a4_bm25_sums", with_(BM25, "select qid, doc_id, score from scored where matched >= need"))
def a4(s, d):
    return search.bm25(doc_index(s, d), bench_queries(s, d), 1 << 30).select("qid", "doc_id", "score")


@query("a5_matched_tokens", with_(INDEX, "select qid, doc_id, count(distinct term) matched from qt join postings using (term) group by all"))
def a5(s, d):
    return _terms_of(s, d).join(doc_index(s, d).postings, "term").groupBy("qid", "doc_id").agg(F.countDistinct("term").alias("matched"))


@query("a11_coverage_by_source", "select source, count(*) n_pages, count(*) filter (doc_id % 4 <> 0) n_indexed, round(count(*) filter (doc_id % 4 <> 0) / count(*), 6) coverage from documents group by source")
def a11(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("doc_id") % 4 != 0).alias("n_indexed"))
    return g.withColumn("coverage", F.round(F.col("n_indexed") / F.col("n_pages"), 6))


@query("j1_term_lookup", with_(INDEX, "select qid, term, doc_id, tf from qt join postings using (term)"))
def j1(s, d):
    return _terms_of(s, d).join(doc_index(s, d).postings, "term").select("qid", "term", "doc_id", "tf")


@query("j2_posting_statistics", with_(INDEX, "select doc_id, term, tf, dl, df from postings join doc_stats using (doc_id) join terms using (term)"))
def j2(s, d):
    i = doc_index(s, d)
    return i.postings.join(i.doc_stats, "doc_id").join(i.terms.select("term", "df"), "term").select("doc_id", "term", "tf", "dl", "df")


@query("j5_hits_with_text", with_(BM25, "select qid, doc_id, source, md5(text) md5 from bm25 join documents using (doc_id) where rank < 5"))
def j5(s, d):
    return bm25_hits(s, d).where("rank < 5").join(doc_index(s, d).docs, "doc_id").select("qid", "doc_id", "source", F.md5("text").alias("md5"))


@query("j8_unstored_pages", with_(_NOW, "select rel from df where status = 'unchanged' and rel not in (select rel from st)"))
def j8(s, d):
    now, old, stored = _snapshots(s, d)
    return incremental.diff(now, old).where("status = 'unchanged'").join(stored, "rel", "left_anti").select("rel")


@query("j9_honest_manifest", with_(_NOW, "select rel from od where rel in (select rel from st)"))
def j9(s, d):
    _, old, stored = _snapshots(s, d)
    return old.join(stored, "rel", "left_semi").select("rel")


@query("j10_gold_match", with_(_EVAL, "select qid, rank::int rank, source from h join gold using (qid) where arm = 'k10' and contains(source, g)"))
def j10(s, d):
    hits = bm25_hits(s, d).where("rank < 10").join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id").withColumn("arm", F.lit("k10"))
    return evaluation.relevance(hits, _gold(s, d)).join(hits.select("qid", "rank", "source"), ["qid", "rank"]).select("qid", F.col("rank").cast("int").alias("rank"), "source")


@query("j13_simhash_bands")
def j13(s, d):
    h = lsh.banded(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), T.simhash(F.split("text", r"\s+")).alias("h")))
    return lsh.candidates(h, h.where("doc_id % 20 = 0"))


@query("j15_feedback_terms", with_(BM25, "select qid, term, sum(tf)::bigint tf from bm25 join postings using (doc_id) where rank < 3 group by all"))
def j15(s, d):
    return bm25_hits(s, d).where("rank < 3").select("qid", "doc_id").join(doc_index(s, d).postings, "doc_id").groupBy("qid", "term").agg(F.sum("tf").alias("tf"))


@query("w1_ranks", with_(_VEC, "select qid, doc_id, rank::int rank from dn"))
def w1(s, d):
    return _dense(s, d, 50).select("qid", "doc_id", F.col("rank").cast("int").alias("rank"))


@query("w2_running_count", with_(BM25, "select qid, doc_id, row_number() over (partition by qid, source order by rank) seen from bm25 join documents using (doc_id)"))
def w2(s, d):
    hits = bm25_hits(s, d).join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id")
    return hits.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid", "source").orderBy("rank")).cast("long").alias("seen"))


@query("w5_context_window", "select conv_id, turn, lag(role) over w before, lead(role) over w after, count(*) over (partition by conv_id order by turn rows between 2 preceding and 2 following) near from conversations where turn is not null window w as (partition by conv_id order by turn, role, text)")
def w5(s, d):
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(s, d, "conversations").where("turn is not null")
    return c.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.count(F.lit(1)).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)).alias("near"))


@query("w6_consecutive_lines", "with l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from (select doc_id, string_split(text, chr(10)) ls from documents)), k as (select doc_id, line, i, lag(line) over (partition by doc_id order by i) prev from l) select doc_id, count(*) filter (prev is null or prev <> line) n_kept from k group by doc_id")
def w6(s, d):
    fold = F.aggregate(
        F.split(F.coalesce("text", F.lit("")), "\n"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("last")),
        lambda acc, x: F.struct((acc.n + F.when(acc.last.isNull() | (acc.last != x), 1).otherwise(0)).alias("n"), x.alias("last")), lambda acc: acc.n,
    )
    return table(s, d, "documents").select("doc_id", fold.alias("n_kept"))


@query("w7_first_relevant_rank", with_(_EVAL, "select qid, r::int first_rank from f where arm = 'k10'"))
def w7(s, d):
    hits = bm25_hits(s, d).where("rank < 10").join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id").withColumn("arm", F.lit("k10"))
    return evaluation.relevance(hits, _gold(s, d)).groupBy("qid").agg(F.min("rank").cast("int").alias("first_rank"))


@query("k1_single_query_topk", with_(BM25, "select doc_id, score from bm25 where qid = (select min(qid) from bm25) and rank < 10"))
def k1(s, d):
    hits = bm25_hits(s, d)
    first = hits.agg(F.min("qid").alias("qid"))
    return hits.join(F.broadcast(first), "qid").orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


@query("k3_fused_slice", with_(BM25 + _OTHER, "select * from (select qid, doc_id, (row_number() over (partition by qid order by s desc, doc_id) - 1)::int rank from (select qid, doc_id, round(sum(1.0::double / (20 + rank)), 12) s from (select qid, doc_id, rank from bm25 union all select qid, doc_id, rank from oth) group by all)) where rank < 5"))
def k3(s, d):
    return fusion.rrf([bm25_hits(s, d), _other(s, d)], 20).where("rank < 5").select("qid", "doc_id", F.col("rank").cast("int").alias("rank"))


@query("k4_mentions_order", "select source, sum((len(lower(text)) - len(replace(lower(text), 'der', ''))) // 3)::bigint count from documents where lower(text) like '%der%' group by source order by count desc, source desc limit 5")
def k4(s, d):
    return search.mentions(table(s, d, "documents"), "der", 5).select("source", "count")


@query("u2_state_sets", with_(_NOW, "(select rel from nw except select rel from od) union all (select rel from nw intersect select rel from od)"))
def u2(s, d):
    now, old, _ = _snapshots(s, d)
    return now.select("rel").subtract(old.select("rel")).unionByName(now.select("rel").intersect(old.select("rel")))


@query("p10_doc_tokens", with_(INDEX, "select doc_id, sum(tf)::bigint n_tokens, count(*) n_terms from tf group by doc_id"))
def p10(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    both = index.term_counts(docs).unionByName(index.path_counts(docs, 3)).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return both.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))


@query("p15_read_page", "with w as (select unnest(['src1', 'src5', 'none']) source), p as (select source, string_agg(text, chr(10) || chr(10) order by doc_id) t from documents where source in (select source from w) group by source) select w.source, t is null missing, case when len(t) > 3000 then t[:3000] || chr(10) || '[... page truncated: ' || (len(t) - 3000) || ' more chars not shown ...]' else t end body from w left join p using (source)")
def p15(s, d):
    wanted = s.range(1).select(F.explode(F.array(F.lit("src1"), F.lit("src5"), F.lit("none"))).alias("source"))
    docs = table(s, d, "documents").select("source", "doc_id", F.col("text"))
    return positions.read_pages(docs.where(F.col("text").isNotNull()), wanted, 3000)


@query("p12_snippet_with_fallback", "with b as (select doc_id, source, trim(regexp_replace(text, '(?m)^(Released under|Licensed under|This work is).*$', '', 'g'), chr(10) || ' ') t from documents), f as (select source, arg_min(t, doc_id) sib from b where len(t) >= 40 group by source) select doc_id, md5(case when len(t) < 40 then sib else t end) h from b left join f using (source)")
def p12(s, d):
    t = F.regexp_replace(F.regexp_replace("text", "(?m)^(Released under|Licensed under|This work is).*$", ""), r"^[\n ]+|[\n ]+\z", "")
    b = table(s, d, "documents").select("doc_id", "source", t.alias("t"))
    f = b.where(F.length("t") >= 40).groupBy("source").agg(F.min_by("t", "doc_id").alias("sib"))
    return b.join(f, "source", "left").select("doc_id", F.md5(F.when(F.length("t") < 40, F.col("sib")).otherwise(F.col("t"))).alias("h"))


_SWEEP = """, arms as (select unnest([5, 20, 60]) k), fu as (select k, qid, doc_id, round(sum(1.0::double / (k + rank)), 12) s from (select qid, doc_id, rank from bm25 union all select qid, doc_id, rank from oth), arms group by all),
rk as (select k, qid, doc_id, row_number() over (partition by k, qid order by s desc, doc_id) - 1 rank from fu), g1 as (select item_id qid, min(doc_id) doc_id from benchmark b join documents d on contains(d.text, b.text) group by 1)"""


@query("v5_rrf_sweep", with_(BM25 + _OTHER + _SWEEP, "select k::int k, round(avg(coalesce(1.0 / (rank + 1), 0)), 6) mrr, count(*) n from (select arms.k, g1.qid, min(rank) rank from arms cross join g1 left join rk on rk.k = arms.k and rk.qid = g1.qid and rk.doc_id = g1.doc_id group by all) group by k"))
def v5(s, d):
    lists = bm25_hits(s, d).select("qid", "doc_id", "rank").unionByName(_other(s, d).select("qid", "doc_id", "rank"))
    arms = s.range(1).select(F.explode(F.array(F.lit(5), F.lit(20), F.lit(60))).alias("k"))
    fused = lists.crossJoin(F.broadcast(arms)).groupBy("k", "qid", "doc_id").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 12).alias("s"))  # three arms
    ranks = fused.withColumn("rank", F.row_number().over(W.partitionBy("k", "qid").orderBy(F.desc("s"), "doc_id")) - 1)
    b = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    gold = evaluation.containing(table(s, d, "documents").select("doc_id", "text"), b).groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    found = gold.crossJoin(F.broadcast(arms)).join(ranks.select("k", "qid", "doc_id", "rank"), ["k", "qid", "doc_id"], "left")
    return found.groupBy("k").agg(F.round(F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))


@query("v5_per_file_sweep", with_(BM25 + _DEDUP, "select 1 cap, count(*) n from src where seen <= 1 union all select 2, count(*) from src where seen <= 2 union all select 3, count(*) from src where seen <= 3"))
def v5b(s, d):
    hits = bm25_hits(s, d).join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id")
    seen = hits.withColumn("seen", F.row_number().over(W.partitionBy("qid", "source").orderBy("rank")))
    caps = s.range(1).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cap"))
    return seen.crossJoin(F.broadcast(caps)).where("seen <= cap").groupBy("cap").agg(F.count(F.lit(1)).alias("n"))
