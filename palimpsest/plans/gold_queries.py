"""Queries of gold sets, rankers, comparisons, stores and run reports (F, R, S, U, V, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import compiling
from palimpsest.functions import text as T
from palimpsest.operators import fusion, generation, gold, manifest, search
from palimpsest.plans.base import BM25, INDEX, bench_queries, bm25_hits, doc_index, table, with_
from palimpsest.plans.search_queries import _EVAL, _HIT, _MM, _OTHER, _gold, _other
from palimpsest.shared import new_path
from palimpsest.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Questions: the first sentence of each turn, with a question mark.
_ASK = "ask as (select conv_id * 1000 + turn qid, role kind, split_part(text, '.', 1) || '?' query from conversations where text is not null and turn is not null)"
_GOOD = "len(query) between 25 and 139 and query like '%?' and not regexp_matches(lower(query), 'this page|the text|according to')"


def _asked(s, d):
    c = table(s, d, "conversations").where("text is not null and turn is not null")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("qid"), F.col("role").alias("kind"), F.concat(F.substring_index("text", ".", 1), F.lit("?")).alias("query"))


@query("f9_gold_candidates", f"with {_ASK} select qid, query from ask where {_GOOD}")
def f9(s, d):
    return _asked(s, d).where(gold.is_question(F.col("query"))).select("qid", "query")


@query("v2_gold_union", "select item_id qid, 'base' as set_name from benchmark where item_id % 2 = 0 union all select item_id, 'ext' from benchmark where item_id % 2 = 1")
def v2(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.array(F.lit("src")).alias("gold"))
    return gold.load({"base": b.where("qid % 2 = 0"), "ext": b.where("qid % 2 = 1")}).select("qid", "set_name")


_EXT = f"with {_ASK}, p as (select *, md5('13:' || qid) place, array_to_string(string_split(lower(query), ' ')[1:5], ' ') prefix from ask where {_GOOD}), o as (select *, row_number() over (partition by prefix order by place, qid) r from p), k as (select *, row_number() over (partition by kind = 'user' order by place, qid) n from o where r = 1)"


@query("v3_prefix_dedupe", _EXT + " select qid, query, kind from k where kind <> 'user' or n <= 8 order by place, qid limit 16")
def v3(s, d):
    asked = _asked(s, d).where(gold.is_question(F.col("query")))
    return gold.extend(asked, 16, 13, "user")


@query("v4_rankers", with_(_EVAL, f"select n.arm, round(avg(coalesce(1.0 / (r + 1), 0)), 6) mrr, {_HIT}, count(*) n_queries from al, (select unnest(['engine', 'table']) arm) n where al.arm = 'k10' group by n.arm"))
def v4(s, d):
    i, q = doc_index(s, d), bench_queries(s, d)
    hits = bm25_hits(s, d).join(i.docs.select("doc_id", "source"), "doc_id")
    return gold.compare({"engine": gold.engine_ranker(i, k=10, per_file=0), "table": gold.table_ranker(hits, 10)}, q, _gold(s, d))


@query("v7_vector_alignment", "select coalesce(vec_id, doc_id) as key, case when doc_id is null then 'no chunk' else 'no vector' end missing from embeddings full join documents on vec_id = doc_id where vec_id is null or doc_id is null")
def v7(s, d):
    return manifest.misaligned(table(s, d, "embeddings").select(F.col("vec_id").alias("key")), table(s, d, "documents").select(F.col("doc_id").alias("key")))


_TWO = """, gold as (select item_id qid, arg_min(source, doc_id) g from benchmark b join documents d on contains(d.text, b.text) group by 1),
hb as (select 'before' arm, qid, rank, source from bm25 join documents using (doc_id) where rank < 10 union all select 'after', qid, rank, source from oth join documents using (doc_id) where rank < 10),
f as (select arm, qid, min(rank) r from hb join gold using (qid) where contains(source, g) group by all),
al as (select arm, qid, r from (select unnest(['before', 'after']) arm) cross join gold left join f using (arm, qid))"""


@query("v8_embedder_regression", with_(BM25 + _OTHER + _TWO + """, a as (select qid, list(doc_id) x from bm25 where rank < 10 group by 1), b as (select qid, list(doc_id) y from oth where rank < 10 group by 1),
dp as (select avg((len(coalesce(x, [])) + len(coalesce(y, [])) - 2 * len(list_intersect(coalesce(x, []), coalesce(y, [])))) // 2) v from a full join b using (qid))""", "select arm, round(avg(coalesce(1.0 / (r + 1), 0)), 6) mrr, (select round(v, 6) from dp) displaced from al group by arm"))
def v8(s, d):
    return gold.regression(bm25_hits(s, d), _other(s, d), _gold(s, d), doc_index(s, d).docs)


@query("v9_rescued", with_(BM25 + _OTHER + _TWO, "select qid from f where arm = 'before' and qid not in (select qid from f where arm = 'after')"))
def v9(s, d):
    return gold.rescued(_other(s, d), bm25_hits(s, d), _gold(s, d), doc_index(s, d).docs)


@query("v9_gold_verify", "select item_id qid, count(d.doc_id) n_docs from benchmark b left join documents d on contains(d.text, b.text) group by 1")
def v9v(s, d):
    return gold.verify(table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage")), table(s, d, "documents").select("doc_id", "text"))


@query("v9_typos", "with w as (select item_id qid, string_split(text, ' ') w, list_max(list_transform(string_split(text, ' '), lambda x: len(x))) n from benchmark), p as (select *, list_position(list_transform(w, lambda x: len(x)), n) place from w) select qid, case when n >= 3 then array_to_string(list_transform(w, lambda x, i: case when i = place then x[1] || x[3] || x[2] || x[4:] else x end), ' ') else array_to_string(w, ' ') end query from p")
def v9t(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), gold.with_typo(F.col("text")).alias("query"))


@query("v9_smoke", "select unnest(['df counts postings', 'has documents', 'has terms', 'postings have documents', 'postings have terms']) as check, true ok")
def v9s(s, d):
    return gold.smoke(doc_index(s, d))


_ARMS = "(values ('first', 'bm', 1), ('first-all', 'bm', 0), ('second', 'ot', 1), ('rrf', 'rr', 1), ('rrf-all', 'rr', 0), ('linear', 'li', 1), ('linear-all', 'li', 0)) t(arm, l, cap)"


@query("v10_config_sweep", with_(BM25 + _OTHER + f""", gold as (select item_id qid, arg_min(source, doc_id) g from benchmark b join documents d on contains(d.text, b.text) group by 1),
rr as (select qid, doc_id, row_number() over (partition by qid order by s desc, doc_id) - 1 rank from (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 12) s from (select qid, doc_id, rank from bm25 union all select qid, doc_id, rank from oth) group by all)),
la as (select qid, doc_id, {_MM} v from bm25), lb as (select qid, doc_id, {_MM} v from oth),
li as (select qid, doc_id, row_number() over (partition by qid order by 0.7::double * coalesce(la.v, 0) + 0.3::double * coalesce(lb.v, 0) desc, doc_id) - 1 rank from la full join lb using (qid, doc_id)),
ls as (select 'bm' l, qid, doc_id, rank from bm25 union all select 'ot', qid, doc_id, rank from oth union all select 'rr', * from rr union all select 'li', * from li),
src as (select l, qid, rank, source, row_number() over (partition by l, qid, source order by rank) seen from ls join documents using (doc_id)),
hit as (select arm, qid, source, row_number() over (partition by arm, qid order by rank) - 1 rank from src join {_ARMS} using (l) where cap = 0 or seen <= cap),
f as (select arm, qid, min(rank) r from hit join gold using (qid) where rank < 10 and contains(source, g) group by all),
al as (select arm, qid, r from (select arm from {_ARMS}) cross join gold left join f using (arm, qid))""", "select arm, round(avg(coalesce(1.0 / (r + 1), 0)), 6) mrr, count(*) n_queries from al group by arm"))
def v10(s, d):
    return gold.sweep(bm25_hits(s, d), _other(s, d), doc_index(s, d).docs, _gold(s, d)).select("arm", "mrr", "n_queries")


@query("r11_rescored", with_(BM25 + f""", src as (select qid, doc_id, rank, row_number() over (partition by qid, source order by rank) seen from bm25 join documents using (doc_id)),
a as (select qid, doc_id, {_MM} v from bm25), oth as (select qid, doc_id, 1000.0::double / (1 + abs(n_chars - 1500)) score from src join documents using (doc_id) where seen = 1),
b as (select qid, doc_id, {_MM} v from oth), m as (select qid, doc_id, round(0.7::double * a.v + 0.3::double * coalesce(b.v, 0), 9) score from a join b using (qid, doc_id))""", "select * from (select qid, doc_id, round(score, 6) score, (row_number() over (partition by qid order by m.score desc, doc_id) - 1)::int rank from m) where rank < 10"))
def r11(s, d):
    hits, docs = bm25_hits(s, d), table(s, d, "documents")
    second = hits.select("qid", "doc_id").join(docs.select("doc_id", "n_chars"), "doc_id").select("qid", "doc_id", (F.lit(1000.0) / (1 + F.abs(F.col("n_chars") - 1500))).alias("score"))
    out = fusion.rescored(hits, second, docs, 0.7, 1, 10)
    return out.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("u3_term_jaccard", with_(INDEX + ", t as (select qid, list(distinct term) x from qt group by qid)", "select a.qid, b.qid other, round(len(list_intersect(a.x, b.x))::double / len(list_distinct(list_concat(a.x, b.x))), 6) v from t a join t b on b.qid between a.qid + 1 and a.qid + 3"))
def u3(s, d):
    t = search.query_tokens(bench_queries(s, d)).groupBy("qid").agg(F.collect_set("qtoken").alias("x"))
    near = t.withColumn("other", F.explode(F.sequence(F.col("qid") + 1, F.col("qid") + 3)))
    return near.join(t.select(F.col("qid").alias("other"), F.col("x").alias("y")), "other").select("qid", "other", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("v"))


@query("a12_run_totals", "select count(*) pages, count(*) filter (doc_id % 7 <> 0 and doc_id % 3 = 0) first_try, count(*) filter (doc_id % 7 <> 0 and doc_id % 3 <> 0) repaired, count(*) filter (doc_id % 7 = 0) fallback, (2 * count(*))::bigint chunks, sum(1 + doc_id % 3)::bigint calls from documents")
def a12(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source"), (F.col("doc_id") % 7 == 0).alias("needs_regen"), (F.col("doc_id") % 3 + 1).alias("calls"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_idx"))
    return compiling.totals(rows)


@query("a16_corpus_quality", "select 2.0::double chunks_per_page, round(avg(case when doc_id % 4 = 0 then 1.0 else 0 end), 6) aux_share, count(*) filter (doc_id % 9 = 0) violations from documents")
def a16(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("markdown"))
    texts = F.array("markdown", F.when(F.col("doc_id") % 9 == 0, F.concat("markdown", F.lit("zzqq"))).otherwise(F.col("markdown")))
    chunks = docs.select("source", F.explode(texts).alias("text"), F.when(F.col("doc_id") % 4 == 0, F.lit("said")).alias("summary"), F.array().cast("array<string>").alias("keywords"))
    return gold.corpus_quality(chunks, docs)


@query("f7_chunk_validation", "select doc_id, trim(text) <> '' as non_empty, len(text) <= 3200 as fits, true as few, true as verbatim, 3 as n_qa from documents")
def f7(s, d):
    qa = F.array(*[F.struct(F.lit(f"q{i}").alias("q"), F.lit("a").alias("a")) for i in range(5)])
    raw = table(s, d, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("page"), F.array(F.struct("text", qa.alias("qa"))).alias("chunks"))
    return generation.validated(raw).select(F.col("source").alias("doc_id"), "non_empty", "fits", "few", "verbatim", F.size("qa").alias("n_qa"))


# --- stores: a page of each document, a chunk of each of its lines


def _line_pages(s, d):
    none = F.array().cast("array<string>")
    docs = table(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.coalesce("text", F.lit("")).alias("t"))
    qa = F.array().cast("array<struct<q:string,a:string>>")
    chunk = lambda x, i: F.struct(T.chunk_uid(F.col("source"), i).alias("chunk_uid"), none.alias("heading_path"), x.alias("text"), F.lit("").alias("summary"), none.alias("keywords"), none.alias("synonyms"), qa.alias("qa"))
    return docs.select("source", F.lit("").alias("title"), F.md5("t").alias("html_md5"), F.lit("g").alias("gen_key"), F.lit("").alias("generated_at"), F.lit("v1").alias("schema_version"), F.lit(False).alias("needs_regen"), F.transform(F.split("t", "\n"), chunk).alias("chunks"))


def _stored(s, d):
    """Stored twice: the second time, some pages take the place of others."""
    path, pages = new_path(s, "corpus"), _line_pages(s, d)
    odd = F.pmod(F.xxhash64("source"), F.lit(3)) == 0
    store.save(pages.withColumn("html_md5", F.when(odd, "old").otherwise(F.col("html_md5"))), path)
    store.replace(pages.where(odd), path)
    return store.load(s, path)[0]


_LINES = "with l as (select concat_ws('/', source, doc_id) source, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 i from documents) select source, i::int chunk_idx, substr(sha1(source || '#' || i), 1, 16) chunk_uid, text from l"


@query("s5_corpus_store", "select concat_ws('/', source, doc_id) source, md5(coalesce(text, '')) html_md5, len(string_split(coalesce(text, ''), chr(10)))::int n_chunks from documents")
def s5(s, d):
    return _stored(s, d).select("source", "html_md5", F.size("chunks").alias("n_chunks"))


@query("s6_corpus_chunks", _LINES)
def s6(s, d):
    return store.flatten(_stored(s, d)).select("source", "chunk_idx", "chunk_uid", "text")


@query("s16_flatten", _LINES)
def s16(s, d):
    return store.flatten(_line_pages(s, d)).select("source", "chunk_idx", "chunk_uid", "text")


_DEL = "list_distinct(list_concat([{0}], list_transform(range(1, len({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1))))"


@query("j12_delete_lookup", with_(INDEX + f", a as (select term qtoken, unnest({_DEL.format('term')}) d from (select distinct term from qt)), b as (select term, unnest({_DEL.format('term')}) d from terms)", "select distinct qtoken, term from a join b using (d)"))
def j12(s, d):
    from palimpsest.operators import expand

    return expand.delete_lookup(doc_index(s, d), search.query_tokens(bench_queries(s, d)))


@query("r17_choose_engine", "with p as (select count(distinct doc_id) n_pages, count(distinct case when doc_id % 20 <> 0 then doc_id end) n_indexed from documents), e as (select *, round(n_indexed / n_pages, 6) coverage from p) select 'none' prefer, *, case when n_indexed = 0 then 'nothing_built' when coverage >= 0.95 then 'new' else 'legacy' end engine from e union all select 'legacy', *, 'legacy' from e")
def r17(s, d):
    from palimpsest.operators import evaluation

    docs = table(s, d, "documents")
    of = lambda p: evaluation.coverage(docs.where("doc_id % 20 <> 0"), docs, "doc_id", p).select(F.lit(p or "none").alias("prefer"), "*")
    return of(None).unionByName(of("legacy"))


@query("r21_guards", "select unnest(['2 vectors for 3 chunks', 'n_chunks: the index has 2, the corpus 3', 'path_boost was 3 when the index was built and is 0 now', 'the vectors are built in part: 1 of 3', 'there are no vectors']) as said")
def r21g(s, d):
    said = manifest.vector_errors(None, 3) + manifest.vector_errors({"count": 1, "complete": False}, 3) + manifest.vector_errors({"count": 2, "complete": True}, 3)
    said += manifest.differences({"n_chunks": 2, "n_pages": 1, "sha": "x"}, {"n_chunks": 3, "n_pages": 1, "sha": "x"}) + manifest.drift({"params": {"path_boost": 3}}, {"path_boost": 0})
    return s.createDataFrame([(x,) for x in said], "said string")


@query("r22_build_index", with_(INDEX, "select 'built,up to date,refused' as said, (select count(*) from terms) n_terms, (select count(*) from postings) n_postings"))
def r22(s, d):
    from palimpsest.operators.index import Index

    docs = table(s, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    path = new_path(s, "index")
    said = [manifest.build(docs, path, "g1"), manifest.build(docs, path, "g1")]
    try:
        said.append(manifest.build(docs, path, "g2"))
    except ValueError:
        said.append("refused")
    i = Index.load(s, path)
    return i.terms.agg(F.count(F.lit(1)).alias("n_terms")).crossJoin(i.postings.agg(F.count(F.lit(1)).alias("n_postings"))).select(F.lit(",".join(said)).alias("said"), "n_terms", "n_postings")  # one row each


@query("x20_jaccard", "select item_id a_id, item_id b_id, 1.0::double v from benchmark")
def x20j(s, d):
    sig = table(s, d, "benchmark").select("item_id", T.minhash(T.char_ngrams(F.col("text"), 3)).alias("x"))
    return sig.join(sig.withColumnsRenamed({"item_id": "b_id", "x": "y"}), F.col("item_id") == F.col("b_id")).select(F.col("item_id").alias("a_id"), "b_id", F.round(T.minhash_jaccard(F.col("x"), F.col("y")), 6).alias("v"))
