"""Queries of the index, search, fusion, expansion, evaluation and state (A, J, W, K, U, R, E, V, I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import reports, udfs
from palimpsest.functions import text as T
from palimpsest.operators import evaluation, expand, fusion, incremental, lsh, manifest, positions, rerank, search
from palimpsest.plans.base import BM25, INDEX, bench_queries, bm25_hits, doc_index, once, table, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- index


@query("a1_postings", with_(INDEX, "select doc_id, term, tf from postings"))
def a1(s, d):
    return doc_index(s, d).postings.select("doc_id", "term", "tf")


@query("a2_terms", with_(INDEX, "select term, df, cf from terms"))
def a2(s, d):
    return doc_index(s, d).terms.select("term", "df", "cf")


@query("a3_collection", with_(INDEX, "select n, round(avgdl, 6) avgdl, total from coll"))
def a3(s, d):
    return doc_index(s, d).coll.select("n", F.round("avgdl", 6).alias("avgdl"), "total")


@query("a3_doc_stats", with_(INDEX, "select doc_id, dl from doc_stats"))
def a3d(s, d):
    return doc_index(s, d).doc_stats


@query("a9_collection_lm", with_(INDEX, "select term, round(cf / total, 9) p from terms, coll"))
def a9(s, d):
    i = doc_index(s, d)
    return i.terms.crossJoin(F.broadcast(i.coll.select("total"))).select("term", F.round(F.col("cf") / F.col("total"), 9).alias("p"))


@query("f1_stop_terms", with_(INDEX, "select term from (select term, count(*) df from tf group by 1), coll where df > n * 0.5"))
def f1(s, d):
    i = doc_index(s, d)
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    from palimpsest.operators import index as ix

    every = ix.term_counts(docs).unionByName(ix.path_counts(docs, 3)).select("doc_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return every.crossJoin(F.broadcast(i.coll.select("n"))).where(F.col("df") > F.col("n") * 0.5).select("term")


@query("f2_prune_df", with_(INDEX, "select term, df from terms where df <= 5"))
def f2(s, d):
    return doc_index(s, d).terms.where("df <= 5").select("term", "df")


@query("r2_idf", with_(INDEX, "select term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) idf from terms, coll"))
def r2(s, d):
    i = doc_index(s, d)
    return i.terms.crossJoin(F.broadcast(i.coll.select("n"))).select("term", F.round(search.idf(F.col("n"), F.col("df")), 6).alias("idf"))


# --- search

_TOP = "select qid, doc_id, round(score, 6) score, rank::int rank from bm25"


def _out(hits, k=10):
    return hits.where(F.col("rank") < k).select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("r3_bm25_top10", with_(BM25, f"{_TOP} where rank < 10"))
def r3(s, d):
    return _out(bm25_hits(s, d))


@query("f3_min_should_match", with_(BM25, "select qid, count(*) n from scored where matched >= need group by qid"))
def f3(s, d):
    every = search.bm25(doc_index(s, d), bench_queries(s, d), 1 << 30)
    return every.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


_DEDUP = ", src as (select b.*, source, row_number() over (partition by qid, source order by rank) seen from bm25 b join documents using (doc_id)), one as (select qid, doc_id, source, score, row_number() over (partition by qid order by rank) - 1 rank from src where seen <= 1)"


@query("search_bm25", with_(BM25 + _DEDUP, "select qid, rank::int rank, doc_id, source, round(score, 6) score from one where rank < 8"))
def search_bm25(s, d):
    hits = fusion.per_source(bm25_hits(s, d).join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id"), 1)
    return hits.where("rank < 8").select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", "source", F.round("score", 6).alias("score"))


@query("f4_per_source_cap", with_(BM25 + _DEDUP, "select qid, source, doc_id from src where seen <= 3"))
def f4(s, d):
    hits = bm25_hits(s, d).join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id")
    return fusion.per_source(hits, 3).select("qid", "source", "doc_id")


@query("f5_source_prefix", "select doc_id, source from documents where source like 'src1%'")
def f5(s, d):
    return search.below(table(s, d, "documents"), ("src1",)).select("doc_id", "source")


@query("j3_candidate_bm25", with_(BM25, "select qid, doc_id, round(score, 6) score from scored where matched >= need and doc_id % 3 = 0"))
def j3(s, d):
    i, q = doc_index(s, d), bench_queries(s, d)
    cand = q.select("qid").crossJoin(i.docs.where("doc_id % 3 = 0").select("doc_id"))
    return search.bm25(i, q, 1 << 30, candidates=cand).select("qid", "doc_id", F.round("score", 6).alias("score"))


_VEC = "ev as (select vec_id doc_id, embedding::double[] e from embeddings), qv as (select vec_id qid, embedding::double[] e from embeddings where vec_id % 20 = 0), dn as (select * from (select qid, doc_id, s score, row_number() over (partition by qid order by s desc, doc_id) - 1 rank from (select qv.qid, ev.doc_id, list_inner_product(ev.e, qv.e) s from ev, qv)) where rank < 50)"


def _dense(s, d, k):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "embedding")
    return search.dense(v, q, k)


@query("r6_dense_top10", with_(_VEC, "select qid, doc_id, round(score, 6) score, rank::int rank from dn where rank < 10"))
def r6(s, d):
    return _out(_dense(s, d, 10))


@query("r18_cosine", "select a.vec_id a_id, b.vec_id b_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) + 1e-8) / (sqrt(list_inner_product(b.e, b.e)) + 1e-8), 6) v from (select vec_id, embedding::double[] e from embeddings) a join (select vec_id, embedding::double[] e from embeddings) b on b.vec_id = a.vec_id + 1")
def r18(s, d):
    v = table(s, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("y"))
    return v.withColumnsRenamed({"vec_id": "a_id", "embedding": "x"}).join(b, "a_id").select("a_id", "b_id", F.round(T.cosine(F.col("x"), F.col("y")), 6).alias("v"))


#: A second ranked list over the same documents: by length, for fusion.
_OTHER = ", oth as (select qid, doc_id, sc score, row_number() over (partition by qid order by sc desc, doc_id) - 1 rank from (select qid, doc_id, 1000.0 / (1 + abs(n_chars - 1500)) sc from q, documents where (doc_id + qid) % 9 = 0))"


def _other(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    # Each query's documents have one remainder, so that the pairs are an equi-join.
    q = bench_queries(s, d).select("qid", F.pmod(-F.col("qid"), F.lit(9)).alias("rest"))
    pairs = docs.withColumn("rest", F.pmod("doc_id", F.lit(9))).join(q, "rest")
    return fusion.ranked(pairs.select("qid", "doc_id", (F.lit(1000.0) / (1 + F.abs(F.col("n_chars") - 1500))).alias("score")))


@query("r8_rrf", with_(BM25 + _OTHER, "select * from (select qid, doc_id, round(s, 9) score, (row_number() over (partition by qid order by s desc, doc_id) - 1)::int rank from (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 12) s from (select qid, doc_id, rank from bm25 union all select qid, doc_id, rank from oth) group by all)) where rank < 10"))
def r8(s, d):
    f = fusion.rrf([bm25_hits(s, d), _other(s, d)])
    return f.where("rank < 10").select("qid", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


_MM = "case when max(score) over (partition by qid) - min(score) over (partition by qid) < 1e-12 then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end"


@query("a7_minmax", with_(BM25, f"select qid, doc_id, round({_MM}, 6) norm from bm25"))
def a7(s, d):
    return fusion.minmax(bm25_hits(s, d)).select("qid", "doc_id", F.round("norm", 6).alias("norm"))


@query("r9_linear_fusion", with_(BM25 + _OTHER + f", a as (select qid, doc_id, {_MM} v from bm25), b as (select qid, doc_id, {_MM} v from oth)", "select qid, doc_id, round(0.5 * coalesce(a.v, 0) + 0.5 * coalesce(b.v, 0), 6) score from a full join b using (qid, doc_id)"))
def r9(s, d):
    return fusion.linear(bm25_hits(s, d), _other(s, d), 0.5).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("r10_blend", with_(BM25 + f", oth as (select qid, doc_id, 1000.0 / (1 + abs(n_chars - 1500)) score from bm25 join documents using (doc_id)), a as (select qid, doc_id, rank ra, {_MM} v from bm25), b as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) - 1 rb, {_MM} v from oth)", "select qid, doc_id, round(0.7 * a.v + 0.3 * b.v + 0.01 / (60 + ra) + 0.01 / (60 + rb), 6) score from a join b using (qid, doc_id)"))
def r10(s, d):
    hits = bm25_hits(s, d)
    second = hits.select("qid", "doc_id").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select("qid", "doc_id", (F.lit(1000.0) / (1 + F.abs(F.col("n_chars") - 1500))).alias("score"))
    return fusion.blend(hits, second, 0.7).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("r12_hybrid_search", with_(BM25 + _OTHER + ", f as (select qid, doc_id, row_number() over (partition by qid order by s desc, doc_id) rank from (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 12) s from (select qid, doc_id, rank from bm25 union all select qid, doc_id, rank from oth where rank < 50) group by all)), g as (select qid, doc_id, source, row_number() over (partition by qid, source order by rank) seen, rank from f join documents using (doc_id))", "select * from (select qid, doc_id, source, (row_number() over (partition by qid order by rank) - 1)::int rank from g where seen = 1) where rank < 8"))
def r12(s, d):
    f = fusion.rrf([bm25_hits(s, d), _other(s, d).where("rank < 50")])
    hits = fusion.per_source(f.join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id"), 1)
    return hits.where("rank < 8").select("qid", "doc_id", "source", F.col("rank").cast("int").alias("rank"))


@query("r13_rerank")
def r13(s, d):
    out = search.search(doc_index(s, d), bench_queries(s, d), k=5, reranker=rerank.lexical_reranker)
    return out.select("qid", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("int").alias("rank"))


@query("r14_explain", with_(BM25 + _OTHER, "select qid, doc_id, round(a.score, 6) bm25, a.rank::int bm25_rank, round(b.score, 6) as dense, b.rank::int dense_rank, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) rrf from bm25 a full join oth b using (qid, doc_id)"))
def r14(s, d):
    e = search.explain(doc_index(s, d), bench_queries(s, d), bm25_hits(s, d), _other(s, d))
    return e.select("qid", "doc_id", F.round("bm25", 6).alias("bm25"), F.col("bm25_rank").cast("int"), F.round("dense", 6).alias("dense"), F.col("dense_rank").cast("int"), F.round("rrf", 9).alias("rrf"))


@query("r14_term_report", with_(INDEX, "select qid, term, coalesce(df, 0)::bigint df from qt left join terms using (term)"))
def r14t(s, d):
    return search.term_report(doc_index(s, d), bench_queries(s, d), 1000).select("qid", "term", "df")


@query("r15_mentions", "select source, sum((len(lower(text)) - len(replace(lower(text), 'then', ''))) // 4)::bigint count from documents where lower(text) like '%then%' group by source order by count desc, source desc limit 10")
def r15(s, d):
    return search.mentions(table(s, d, "documents"), "then", 10).select("source", "count")


@query("a6_mentions_context", r"with c as (select source, doc_id, text, (len(text) - len(replace(text, 'The', ''))) // 3 n, strpos(text, 'The') p from documents where source like 'src1%' and contains(text, 'The')) select source, sum(n)::bigint count, arg_min(regexp_replace(substr(text, greatest(p - 20, 1), p + 23 - greatest(p - 20, 1)), '\s+', ' ', 'g'), doc_id) context from c group by source")
def r16(s, d):
    return search.mentions(table(s, d, "documents"), "The", 1000, 20, ("src1",), ignore_case=False)


@query("r21_alignment_guard", "select vec_id from embeddings where vec_id not in (select doc_id from documents where doc_id % 2 = 0)")
def r21(s, d):
    docs = table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("vec_id"))
    return table(s, d, "embeddings").join(docs, "vec_id", "left_anti").select("vec_id")


_PG = "pg as (select doc_id, source, text, row_number() over (partition by source order by doc_id) - 1 pos, count(*) over (partition by source) n_chunks, sum(len(text)) over (partition by source)::bigint chars from documents)"


def _positions(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    placed = positions.numbered_within(docs, "source", ["doc_id"], "pos")
    sizes = positions.page_sizes(docs).withColumnRenamed("source", "page")
    return placed.join(sizes, F.col("source").eqNullSafe(F.col("page"))).drop("page")


@query("p14_neighbours", with_(BM25 + ", " + _PG, "select h.qid, h.doc_id, c.doc_id n_doc from bm25 h join pg a on a.doc_id = h.doc_id join pg c on c.source = a.source and c.pos between a.pos - 1 and a.pos + 1 and c.pos <> a.pos where h.rank < 5"))
def p14(s, d):
    pos = _positions(s, d)
    hits = bm25_hits(s, d).where("rank < 5").join(pos.select("doc_id", "source", "pos"), "doc_id")
    near = search.neighbours(hits, pos.select("source", "pos", F.col("doc_id").alias("text")))
    return near.select("qid", "doc_id", F.col("n_text").alias("n_doc"))


@query("p16_page_payload", with_(_PG, "select doc_id, pos::int pos, n_chunks, chars from pg"))
def p16(s, d):
    return _positions(s, d).select("doc_id", F.col("pos").cast("int").alias("pos"), "n_chunks", "chars")


@query("p17_first_sources", with_(BM25, "select * from (select qid, source, (row_number() over (partition by qid order by r) - 1)::int place from (select qid, source, min(rank) r from bm25 join documents using (doc_id) group by all)) where place < 3"))
def p17(s, d):
    hits = bm25_hits(s, d).join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id")
    return search.first_sources(hits, 3).select("qid", "source", F.col("place").cast("int").alias("place"))


@query("p18_markdown", with_(BM25 + _DEDUP + """, ln as (select qid, string_agg((rank + 1) || '. **doc ' || doc_id || '** `' || source || '` score=' || printf('%.4f', score) || chr(10) || '  > ' || trim(regexp_replace(text[:40], '\\s+', ' ', 'g')) || chr(10) || '  read: ' || source, chr(10) order by rank) t from one join (select doc_id, text from documents) using (doc_id) where rank < 3 group by qid),
kn as (select qid, count(*) n, count(df) k from qt left join terms using (term) group by qid)""", "select qid, '### ' || query || ' (bm25-only)' || chr(10) || coalesce(t, 'no results') as head, coalesce(k || '/' || n, '') as known from q left join ln using (qid) left join kn using (qid)"))
def p18(s, d):
    i, q = doc_index(s, d), bench_queries(s, d)
    hits = search.search(i, q, k=3).join(i.docs.select("doc_id", "text"), "doc_id").withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).withColumn("snippet", F.substring("text", 1, 40))
    out = search.to_markdown(hits, q, search.term_report(i, q, 1000), bm25_only=True)
    return out.select("qid", F.substring_index("markdown", "\nterms in index: ", 1).alias("head"), F.regexp_extract("markdown", r"\nterms in index: (\d+/\d+) ", 1).alias("known"))


@query("w4_positional_ids", "select doc_id, (row_number() over (order by source, doc_id) - 1)::bigint pos from documents")
def w4(s, d):
    return positions.numbered(table(s, d, "documents").select("doc_id", "source"), ["source", "doc_id"], "pos").select("doc_id", "pos")


@query("k7_head_of_work", "select doc_id from documents order by source, doc_id limit 25")
def k7(s, d):
    return table(s, d, "documents").orderBy("source", "doc_id").limit(25).select("doc_id")


@query("k8_seeded_sample", "select doc_id from documents order by md5('0:' || doc_id), doc_id limit 40")
def k8(s, d):
    return table(s, d, "documents").orderBy(F.md5(F.concat(F.lit("0:"), F.col("doc_id").cast("string"))), "doc_id").limit(40).select("doc_id")


@query("u1_union_of_terms", "select distinct w from (select unnest(string_split(lower(text), ' ')) w from benchmark union all select unnest(string_split(lower(text), ' ')) w from conversations)")
def u1(s, d):
    words = lambda t: table(s, d, t).select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return words("benchmark").unionByName(words("conversations")).distinct()


@query("u5_except", "select doc_id from documents except select doc_id from labels")
def u5(s, d):
    return table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id"))


# --- expansion and difficulty


@query("e1_rm3", with_(BM25 + """, fb as (select qid, term, sum(tf) tf from bm25 join postings using (doc_id) where rank < 3 group by all),
pr as (select qid, term, tf / sum(tf) over (partition by qid) p from fb), best as (select * from (select *, row_number() over (partition by qid order by p desc, term) r from pr) where r <= 10),
u as (select qid, term, 0.5 / count(*) over (partition by qid) w from qt union all select qid, term, 0.5 * p from best)""", "select qid, term, round(sum(w), 6) weight, greatest(1, floor(sum(w) * 10 + 1e-9))::bigint repeats from u group by all"))
def e1(s, d):
    out = expand.rm3(doc_index(s, d), bench_queries(s, d), bm25_hits(s, d))
    return out.select("qid", "term", F.round("weight", 6).alias("weight"), "repeats")


@query("e2_rocchio", with_(BM25 + """, m as (select qid, term, 0.75 * tf / 3 w from bm25 join postings using (doc_id) where rank < 3 and qid in (select qid from bm25 where rank = 9) union all select qid, term, -0.15 * tf / 3 from bm25 join postings using (doc_id) where rank between 7 and 9 and qid in (select qid from bm25 where rank = 9)),
g as (select qid, term, sum(w) w from m group by all having sum(w) > 0), best as (select * from (select *, row_number() over (partition by qid order by round(w, 9) desc, term) r from g) where r <= 10),
u as (select qid, term, 1.0 w from qt union all select qid, term, w from best)""", "select qid, term, round(sum(w), 6) weight from u group by all"))
def e2(s, d):
    hits = bm25_hits(s, d)
    full = hits.where("rank = 9").select("qid")
    some = lambda c: hits.where(c).join(full, "qid", "left_semi").select("qid", "doc_id")
    out = expand.rocchio(doc_index(s, d), bench_queries(s, d), some("rank < 3"), some("rank between 7 and 9"))
    return out.select("qid", "term", F.round("weight", 6).alias("weight"))


@query("e5_e6_e7_difficulty", with_(INDEX + """, k as (select qid, term, df, cf, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from qt join terms using (term), coll),
a as (select qid, avg(idf) avg_idf, max(idf) max_idf, avg(idf * ln(1 + cf)) scq from k group by 1),
sc as (select qid, count(distinct doc_id) / any_value(n) scope from k join postings using (term), coll group by qid),
said as (select qid, term, count(*) c from (select qid, unnest(terms) term from qw join ex using (word)) group by all),
cl as (select qid, sum(p * ln(p / coalesce(cf / total, 1e-12))) clarity from (select qid, term, c / sum(c) over (partition by qid) p from said) left join terms using (term), coll group by qid)""", "select qid, round(coalesce(avg_idf, 0), 6) avg_idf, round(coalesce(max_idf, 0), 6) max_idf, round(coalesce(scq, 0), 6) scq, round(coalesce(scope, 0), 6) as scope, round(coalesce(clarity, 0), 6) clarity, coalesce(avg_idf, 0) < 2 is_hard from q left join a using (qid) left join sc using (qid) left join cl using (qid)"))
def e5(s, d):
    out = expand.difficulty(doc_index(s, d), bench_queries(s, d))
    return out.select("qid", *[F.round(c, 6).alias(c) for c in ("avg_idf", "max_idf", "scq", "scope", "clarity")], "is_hard")


# --- evaluation: the documents that hold a benchmark passage are its gold

def _gold(s, d):
    docs, b = table(s, d, "documents").select("doc_id", "source", "text"), table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    found = evaluation.containing(docs, b).join(docs.select("doc_id", "source"), "doc_id")
    return once(s, d, "gold", lambda: found.groupBy("qid").agg(F.array(F.min_by("source", "doc_id")).alias("gold")).cache())


_EVAL = BM25 + """, gold as (select item_id qid, arg_min(source, doc_id) g from benchmark b join documents d on contains(d.text, b.text) group by 1),
arms as (select 'k10' arm, 10 lim union all select 'k3', 3),
h as (select arm, qid, rank, source from bm25 join documents using (doc_id), arms where rank < lim),
f as (select arm, qid, min(rank) r from h join gold using (qid) where contains(source, g) group by all),
al as (select arm, qid, r from arms cross join gold left join f using (arm, qid))"""
_HIT = ", ".join(f"round(avg(case when r < {k} then 1.0 else 0 end), 6) hit_{k}, round(avg(case when r < {k} then 1.0 else 0 end), 6) recall_{k}" for k in evaluation.KS)


def _results(s, d):
    hits = bm25_hits(s, d).join(doc_index(s, d).docs.select("doc_id", "source"), "doc_id")
    arms = [hits.where(F.col("rank") < k).select(F.lit(f"k{k}").alias("arm"), "qid", "rank", "source") for k in (10, 3)]
    return evaluation.evaluate(arms[0].unionByName(arms[1]), _gold(s, d))


@query("v1_evaluate", with_(_EVAL, f"select arm, round(avg(coalesce(1.0 / (r + 1), 0)), 6) mrr, {_HIT}, count(*) n_queries from al group by arm"))
def v1(s, d):
    return _results(s, d)


@query("v6_gate", with_(_EVAL + ", e as (select arm, avg(coalesce(1.0 / (r + 1), 0)) mrr, avg(case when r < 10 then 1.0 else 0 end) hit from al group by arm)", "select arm, case when round(mrr, 6) >= 0.3 and round(hit, 6) >= 0.4 then 'PASS' else 'FAIL' end verdict from e"))
def v6(s, d):
    return evaluation.gate(_results(s, d), F.lit(1.0), 0.3, 0.4).select("arm", "verdict")


@query("a14_displacement", with_(BM25 + _OTHER + ", a as (select qid, list(doc_id) x from bm25 where rank < 10 group by 1), b as (select qid, list(doc_id) y from oth where rank < 10 group by 1)", "select qid, ((len(coalesce(x, [])) + len(coalesce(y, [])) - 2 * len(list_intersect(coalesce(x, []), coalesce(y, [])))) // 2)::bigint displaced from a full join b using (qid)"))
def a14(s, d):
    return evaluation.displacement(bm25_hits(s, d), _other(s, d))


@query("x25_ndcg", with_(BM25 + ", gr as (select qid, doc_id, rank, quality rel from bm25 join (select distinct doc_id, quality from labels) using (doc_id)), g as (select *, row_number() over (partition by qid order by rel desc, doc_id) - 1 best from gr), s as (select qid, sum(case when rank < 10 then (2 ** rel - 1) / log2(rank + 2) else 0 end) dcg, sum(case when best < 10 then (2 ** rel - 1) / log2(best + 2) else 0 end) ideal from g group by 1)", "select qid, round(dcg, 6) dcg, round(case when ideal > 0 then dcg / ideal else 0 end, 6) ndcg from s"))
def x25(s, d):
    rel = table(s, d, "labels").select("doc_id", F.col("quality").alias("rel")).distinct()
    out = evaluation.ndcg(bm25_hits(s, d).join(rel, "doc_id"))
    return out.select("qid", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


@query("a13_token_estimate", "select source, sum(floor(n_chars / 3.07 + 16))::bigint tokens_in, round(sum(floor(n_chars / 3.07 + 16)) * 2.04, 2) tokens_out from documents group by source")
def a13(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.sum(reports.token_estimate(F.col("n_chars"))).alias("tokens_in"))
    return g.withColumn("tokens_out", F.round(F.col("tokens_in") * 2.04, 2))


@query("x30_cost", "select source, round((sum(floor(n_chars / 3.07 + 16)) * 0.5 + sum(floor(n_chars / 3.07 + 16)) * 2.04 * 1.5) / 1e6, 8) cost from documents group by source")
def x30(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.sum(reports.token_estimate(F.col("n_chars"))).alias("t"))
    return g.select("source", F.round(reports.cost(F.col("t"), F.col("t") * 2.04, 0.5, 1.5), 8).alias("cost"))


@query("a15_query_scope", with_(INDEX, "select qid, count(distinct doc_id) n_docs from qt join postings using (term) group by qid"))
def a15(s, d):
    t = search.query_tokens(bench_queries(s, d)).withColumnRenamed("qtoken", "term")
    return t.join(doc_index(s, d).postings, "term").groupBy("qid").agg(F.countDistinct("doc_id").alias("n_docs"))


@query("a8_page_map", "select source, string_agg(doc_id::varchar, ',' order by doc_id) ids from documents group by source")
def a8(s, d):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return table(s, d, "documents").groupBy("source").agg(F.array_join(ids, ",").alias("ids"))


# --- incremental: a snapshot of the documents, and an older one without some and with others changed

_NOW = "nw as (select doc_id::varchar rel, md5(text) md5 from documents where doc_id % 11 <> 3), od as (select doc_id::varchar rel, case when doc_id % 7 = 2 then md5(text || '!') else md5(text) end md5 from documents where doc_id % 13 <> 5), df as (select rel, case when od.md5 is null then 'added' when nw.md5 is null then 'removed' when nw.md5 <> od.md5 then 'changed' else 'unchanged' end status from nw full join od using (rel)), st as (select doc_id::varchar rel from documents where doc_id % 17 <> 1)"


def _snapshots(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("rel"), "text")
    now = docs.where("doc_id % 11 <> 3").select("rel", F.md5("text").alias("md5"))
    old = docs.where("doc_id % 13 <> 5").select("rel", F.when(F.col("doc_id") % 7 == 2, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("md5"))
    return now, old, docs.where("doc_id % 17 <> 1").select("rel")


@query("j7_i1_diff", with_(_NOW, "select rel, status from df"))
def j7(s, d):
    now, old, _ = _snapshots(s, d)
    return incremental.diff(now, old)


@query("i1_plan_work", with_(_NOW, "select rel from df where status in ('added', 'changed') union all select rel from df where status = 'unchanged' and rel not in (select rel from st)"))
def i1(s, d):
    now, old, stored = _snapshots(s, d)
    return incremental.plan_work(incremental.diff(now, old), stored)


@query("i2_merge_state", with_(_NOW, "select rel, md5, 'g1' gen_key, false needs_regen from od where rel not in (select rel from nw) union all select rel, md5, 'g2', true from nw"))
def i2(s, d):
    now, old, _ = _snapshots(s, d)
    state = lambda x, g, n: x.select("rel", "md5", F.lit(g).alias("gen_key"), F.lit(n).alias("needs_regen"))
    return incremental.merge_state(state(old, "g1", False), state(now, "g2", True))


@query("i3_finalize", with_(_NOW, "select rel, md5 from od where rel in (select rel from st) and rel not in (select rel from df where status = 'removed')"))
def i3(s, d):
    now, old, stored = _snapshots(s, d)
    return incremental.finalize(old, stored, incremental.diff(now, old))


@query("i4_missing_vectors", "select doc_id::varchar chunk_uid from documents where not (doc_id % 3 = 0 or (doc_id % 5 = 0 and text not like '%z%'))")
def i4(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_uid"), "text", "doc_id")
    done = docs.where("doc_id % 3 = 0 or doc_id % 5 = 0").select("chunk_uid", F.when((F.col("doc_id") % 3 != 0) & F.contains("text", F.lit("z")), F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("text_md5"))
    return incremental.missing_vectors(docs.select("chunk_uid", "text"), done).select("chunk_uid")


@query("s12_index_manifest", "select count(*) n_chunks, count(distinct source) n_pages, lpad(lower(to_hex(bit_xor(('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), 1, 15))::bigint))), 15, '0') sha from documents")
def s12(s, d):
    return manifest.of_chunks(table(s, d, "documents"), "doc_id").select("n_chunks", "n_pages", "sha")


# --- fuzzy matching, near-duplicates and learned ranking


@query("j11_fuzzy_terms", with_(INDEX, "select qid, qtoken, term from (select distinct qid, term qtoken from qt) join terms on term <> qtoken and term[1] = qtoken[1] and abs(len(term) - len(qtoken)) <= 1 and damerau_levenshtein(term, qtoken) <= 1"))
def j11(s, d):
    tokens = search.query_tokens(bench_queries(s, d))
    near = expand.fuzzy_terms(doc_index(s, d), tokens, 1, most=1 << 30)
    return tokens.distinct().join(near, "qtoken").select("qid", "qtoken", "term")


@query("r4_fuzzy_search")
def r4(s, d):
    i, q = doc_index(s, d), bench_queries(s, d)
    exp = expand.fuzzy_terms(i, search.query_tokens(q), 1)
    return _out(search.bm25(i, q, 10, expansions=exp.select("qtoken", "term")))


@query("x7_jaro", "select a.item_id a_id, b.item_id b_id, round(jaro_similarity(string_split(a.text, ' ')[1], string_split(b.text, ' ')[1]), 6) v from benchmark a join benchmark b on b.item_id between a.item_id + 1 and a.item_id + 5 where regexp_matches(string_split(a.text, ' ')[1] || string_split(b.text, ' ')[1], '^[A-Za-z.,]+$')")
def x7(s, d):
    w = table(s, d, "benchmark").select(F.col("item_id").alias("b_id"), F.get(F.split("text", " "), F.lit(0)).alias("b"))
    a = w.select(F.col("b_id").alias("a_id"), F.col("b").alias("a"), F.explode(F.sequence(F.col("b_id") + 1, F.col("b_id") + 5)).alias("b_id"))
    return a.join(w, "b_id").where(F.concat("a", "b").rlike(r"^[A-Za-z.,]+\z")).select("a_id", "b_id", F.round(udfs.jaro("a", "b"), 6).alias("v"))


def _vocabulary(s, d):
    return doc_index(s, d).terms.select("term")


@query("x1_osa")
def x1(s, d):
    t = _vocabulary(s, d)
    return t.select("term", udfs.osa("term", F.reverse("term")).alias("v"))


@query("x8_jaro_winkler")
def x8(s, d):
    return _vocabulary(s, d).select("term", F.round(udfs.jaro_winkler(F.col("term"), F.reverse("term")), 6).alias("v"))


@query("x13_sparse_cosine", with_(INDEX + ", nm as (select doc_id, sqrt(sum(tf::double * tf)) n from postings group by 1), dt as (select a.doc_id, sum(a.tf::double * b.tf) v from postings a join postings b on b.doc_id = a.doc_id + 1 and b.term = a.term group by 1)", "select x.doc_id, round(coalesce(v, 0) / (x.n * y.n), 6) v from nm x join nm y on y.doc_id = x.doc_id + 1 left join dt on dt.doc_id = x.doc_id"))
def x13(s, d):
    i = doc_index(s, d)
    m = i.postings.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("tf").cast("double")))).alias("m"))
    b = m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("m").alias("y"))
    return m.join(b, "doc_id").select("doc_id", F.round(T.sparse_cosine(F.col("m"), F.col("y")), 6).alias("v"))


@query("x15_metaphone")
def x15(s, d):
    return _vocabulary(s, d).select("term", udfs.metaphone("term").alias("code"))


@query("x16_porter")
def x16(s, d):
    return _vocabulary(s, d).select("term", udfs.porter_simplified("term").alias("stem"))


@query("x17_spelling")
def x17(s, d):
    words = search.query_tokens(bench_queries(s, d)).select(F.concat(F.col("qtoken"), F.lit("x")).alias("word"))
    return expand.spell(doc_index(s, d), words)


@query("x19_simhash_lsh")
def x19(s, d):
    # T.simhash() of whole texts, its votes counted by aggregates; a null text counts as empty.
    rows = table(s, d, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    tokens = rows.select("row", "doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("t")).select("row", "doc_id", F.xxhash64("t").alias("x"))
    votes = tokens.groupBy("row", "doc_id").agg(*[F.sum(F.getbit("x", F.lit(i)) * 2 - 1).alias(f"b{i}") for i in range(64)])
    bits = [F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    h = votes.select("doc_id", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("h"))
    return lsh.simhash_classes(h)


@query("r19_hash_embedding")
def r19(s, d):
    e = udfs.hash_embedder(64)
    return table(s, d, "benchmark").select("item_id", F.array_join(F.transform(e("text"), lambda x: F.round(x.cast("double"), 5).cast("string")), ",").alias("v"))


def _pool(s, d):
    return bm25_hits(s, d).where("rank < 50").join(doc_index(s, d).docs, "doc_id")


@query("e3_mmr")
def e3(s, d):
    c = _pool(s, d).select("qid", "doc_id", "score", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("tokens"))
    return rerank.mmr(c)


@query("e4_xquad")
def e4(s, d):
    c = _pool(s, d).join(bench_queries(s, d), "qid").select("qid", "doc_id", "score", F.array_intersect(F.array_distinct(T.tokenize(F.col("text"))), T.query_terms(F.col("query"))).alias("aspects"))
    return rerank.xquad(c)


def _features(s, d):
    rel = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("rel"))
    n = F.length("text")
    rows = _pool(s, d).join(rel, "doc_id").select("qid", "doc_id", "rel", F.array(F.col("score") / 20, F.log(n + 1.0) / 10, F.length(F.regexp_replace("text", "[^#$%&*!|]", "")) / n).alias("f"))
    return once(s, d, "features", lambda: rows.cache())


def _train(s, d):
    import numpy as np

    # The candidates of a sample of queries: at most 40 times 50 rows.
    got = _features(s, d).where("qid < 40").orderBy("qid", "doc_id").limit(2000).toPandas()
    x = np.array(got["f"].tolist()).reshape(-1, 3)
    return x, got["rel"].to_numpy(dtype=float), got["qid"].to_numpy()


def _ranking(s, d, score):
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("s"), "doc_id")) - 1
    return _features(s, d).withColumn("s", F.round(score, 9)).select("qid", "doc_id", r.alias("place"))


@query("e8_coordinate_ascent")
def e8(s, d):
    return _ranking(s, d, rerank.linear_score(F.col("f"), rerank.coordinate_ascent(*_train(s, d))))


@query("e9_rank_svm")
def e9(s, d):
    return _ranking(s, d, rerank.linear_score(F.col("f"), rerank.rank_svm(*_train(s, d), epochs=3)))


@query("e10_rank_boost")
def e10(s, d):
    return _ranking(s, d, rerank.boosted_score(F.col("f"), rerank.rank_boost(*_train(s, d))))
