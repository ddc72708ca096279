"""Queries of ingest, stores, generation and streams (S, P, I, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import udfs
from palimpsest.operators import generation, vectors
from palimpsest.plans.base import INDEX, table, with_
from palimpsest.shared import new_path
from palimpsest.sources import markdown
from palimpsest.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _scratch(spark) -> str:
    return new_path(spark, "query")


@query("p3_markdown")
def p3(s, d):
    return markdown.extract(table(s, d, "pages"), "page_id")


@query("p5_clean_text")
def p5(s, d):
    clean = F.pandas_udf(lambda x: x.map(markdown.clean), "string")
    return table(s, d, "pages").select("page_id", clean("html").alias("text"))


def _pages(s, d):
    return markdown.extract(table(s, d, "pages"), "page_id").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), "title", "markdown")


@query("i9_generate_corpus")
def i9(s, d):
    return generation.generate(_pages(s, d)).select("source", "chunk_idx", "text", "needs_regen")


@query("i10_heuristic_corpus")
def i10(s, d):
    return generation.heuristic(_pages(s, d)).select("source", "chunk_idx", "text", "chunk_uid")


#: Answers as models write them: plain, fenced, cut off, with a comma too many, and none at all.
_RAW = """r as (select doc_id, case doc_id % 5 when 0 then '{"n":' || doc_id || ',"ok":true}' when 1 then '```json' || chr(10) || '{"n":' || doc_id || ',"ok":true}' || chr(10) || '```' when 2 then 'Here: {"n":' || doc_id || ',"ok":true' when 3 then '{"n":' || doc_id || ',"ok":true,}' else 'no object' end raw from documents)"""


@query("x22_extract_json", f"with {_RAW} select doc_id, case when doc_id % 5 = 4 then null else '{{\"n\": ' || doc_id || ', \"ok\": true}}' end obj from r")
def x22(s, d):
    j = F.concat(F.lit('{"n":'), F.col("doc_id").cast("string"), F.lit(',"ok":true'))
    raw = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(j, F.lit("}")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("```json\n"), j, F.lit("}\n```")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Here: "), j))
        .when(F.col("doc_id") % 5 == 3, F.concat(j, F.lit(",}")))
        .otherwise("no object")
    )
    return table(s, d, "documents").select("doc_id", udfs.extract_json(raw).alias("obj"))


@query("x24_typed_decode", "select event_id, event_type, round(value, 4) as value from events")
def x24(s, d):
    e = table(s, d, "events")
    text = F.to_json(F.struct("event_id", "event_type", "value"))
    got = F.from_json(text, "event_id bigint, event_type string, value double", {"mode": "FAILFAST"})
    return e.select(got.alias("e")).select("e.event_id", "e.event_type", F.round("e.value", 4).alias("value"))


@query("t7_nfkc", "select item_id, nfc_normalize(lower(text)) t from benchmark")
def t7(s, d):
    return table(s, d, "benchmark").select("item_id", udfs.nfkc("text").alias("t"))


@query("s8_index_round_trip", with_(INDEX, "select term, df, cf from terms"))
def s8(s, d):
    from palimpsest.operators.index import Index
    from palimpsest.plans.base import doc_index

    path = _scratch(s)
    doc_index(s, d).save(path, 8)
    return Index.load(s, path).terms.select("term", "df", "cf")


@query("s9_vector_round_trip", "select vec_id, round(list_sum(embedding::double[]), 4) total, (select max(len(embedding)) from embeddings)::bigint as dim, (select count(*) from embeddings) as n, 'given' as model, false as normalized from embeddings")
def s9(s, d):
    path, rows = _scratch(s), table(s, d, "embeddings")
    vectors.save(rows, path, "given", rows.agg(F.max(F.size("embedding"))).first()[0], False)
    got, meta = vectors.load(s, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    of = {"dim": F.lit(meta["dim"]).cast("long"), "n": F.lit(meta["count"]).cast("long"), "model": F.lit(meta["model"]), "normalized": F.lit(meta["normalized"])}
    return got.select("vec_id", F.round(total, 4).alias("total"), *[c.alias(n) for n, c in of.items()])


@query("i4_resumed_vectors", "select doc_id::varchar chunk_uid, md5(coalesce(text, '')) text_md5, 32::bigint dim from documents where doc_id is not null")
def i4_build(s, d):
    path, model = _scratch(s), vectors.get_embedder("hash", 32)
    chunks = table(s, d, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("chunk_uid"), "text")
    before = chunks.where("chunk_uid like '%7'").select("chunk_uid", F.lit("of another day").alias("text"))
    vectors.build(chunks.where("chunk_uid not like '%7'").unionByName(before), path, model, 2, stop_after=1)  # breaks off
    vectors.build(chunks, path, model, 2)
    return vectors.load(s, path)[0].select("chunk_uid", "text_md5", F.size("embedding").cast("long").alias("dim"))


@query("r7_encode_queries", "select item_id, 64::bigint dim, 1.0::double norm from benchmark where len(text) > 0")
def r7(s, d):
    v = vectors.encode(table(s, d, "benchmark").where("length(text) > 0"), vectors.get_embedder("hash", 64), queries=True)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return v.select("item_id", F.size("embedding").cast("long").alias("dim"), F.round(norm, 5).alias("norm"))


@query("i1_streaming_ingest", "select 'u' || user_id rel, md5(text) md5 from (select user_id, arg_max(text, ts || '~' || text) text from (select user_id, ts, event_type || ':' || event_id as text from events) group by user_id)")
def stream(s, d):
    events = table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rel"), F.col("ts").cast("string").alias("ts"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("text"))
    at = _scratch(s)
    events.repartition(3).write.parquet(f"{at}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ingest.ingest(stream, f"{at}/state", f"{at}/ck").awaitTermination()
    return ingest.current(s, f"{at}/state").select("rel", "md5")


@query("extra_windowed_counts", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def windowed(s, d):
    w = ingest.windowed_counts(table(s, d, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
