"""Command line: compile pages, build an index, search it, list mentions, show states.

python -m palimpsest compile  --pages PATH --corpus PATH [--key NAME] [--workers N] [--regen] [--force] [--only REL] [--max-files N] [--dry-run] [--clean] [--provider FILE]
python -m palimpsest audit-corpus --pages PATH --corpus PATH
python -m palimpsest build    --docs PATH --index PATH [--key NAME] [--force]
python -m palimpsest vectors  --docs PATH --index PATH [--embedder NAME] [--dim N]
python -m palimpsest search   --index PATH --query TEXT [--query-file FILE] [--mode bm25|dense|hybrid] [--k N] [--rerank | --no-rerank] [--explain] [--json | --text] [--out FILE]
python -m palimpsest mentions --index PATH --term TEXT [--limit N] [--context N] [--json]
python -m palimpsest status   --index PATH [--docs PATH] [--prefer new|legacy]
python -m palimpsest repl     --index PATH < requests.jsonl
python -m palimpsest serve    --index PATH [--port N]

Pages are a table (rel, html) or a folder of *.html files. search prints Markdown.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest import compiling
from palimpsest.config import Settings, read_queries
from palimpsest.functions import text as T
from palimpsest.operators import evaluation, generation, manifest, rerank, search, vectors
from palimpsest.operators import index as ix
from palimpsest.sources import connectors, pages


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--docs", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--path-boost", type=int)
    b.add_argument("--key", default="")
    b.add_argument("--force", action="store_true")
    c = sub.add_parser("compile")
    for flag in ("--regen", "--force", "--dry-run", "--clean"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--key", default="v1")
    c.add_argument("--workers", type=int)
    c.add_argument("--only")
    c.add_argument("--max-files", type=int)
    c.add_argument("--provider", action="append", default=[])
    for x in (c, sub.add_parser("audit-corpus")):
        x.add_argument("--pages", required=True)
        x.add_argument("--corpus", required=True)
    v = sub.add_parser("vectors")
    v.add_argument("--docs", required=True)
    v.add_argument("--index", required=True)
    v.add_argument("--embedder", default="hash")
    v.add_argument("--dim", type=int, default=384)
    s = sub.add_parser("search")
    s.add_argument("--index", required=True)
    s.add_argument("--query", action="append", default=[])
    s.add_argument("--query-file")
    s.add_argument("--k", type=int)
    s.add_argument("--snippet-width", type=int, default=500)
    s.add_argument("--explain", action="store_true")
    s.add_argument("--mode", choices=["bm25", "dense", "hybrid"])
    s.add_argument("--out")
    how = s.add_mutually_exclusive_group()
    how.add_argument("--json", action="store_true")
    how.add_argument("--text", action="store_true")
    again = s.add_mutually_exclusive_group()
    again.add_argument("--rerank", action="store_true", default=None)
    again.add_argument("--no-rerank", dest="rerank", action="store_false")
    m = sub.add_parser("mentions")
    m.add_argument("--index", required=True)
    m.add_argument("--term", required=True)
    m.add_argument("--limit", type=int, default=60)
    m.add_argument("--context", type=int, default=0)
    m.add_argument("--json", action="store_true")
    t = sub.add_parser("status")
    t.add_argument("--index", required=True)
    t.add_argument("--docs")
    t.add_argument("--prefer", choices=["new", "legacy"])
    sub.add_parser("repl").add_argument("--index", required=True)
    v = sub.add_parser("serve")
    v.add_argument("--index", required=True)
    v.add_argument("--port", type=int, default=8765)
    for x in (b, s):
        x.add_argument("--config", action="append", default=[])
    return p


def _pages(spark: SparkSession, path: str):
    """(rel, md5, html) of a table, or of a folder of HTML files."""
    found = pages.scan(spark, [path])
    if not found.isEmpty():
        return found.withColumn("rel", T.relative_path(F.col("rel"), path if ":" in path else f"file:{path}"))
    return spark.read.parquet(path).select(F.col("rel").cast("string").alias("rel"), F.md5("html").alias("md5"), "html")


def _client(files: list[str]):
    """What makes the client: the local one, or a pool of the providers in JSON files."""
    if not files:
        return lambda: generation.local_client
    given = {f: connectors.Provider(**json.loads(Path(f).read_text())) for f in files}
    return generation.pooled(lambda: {f: connectors.create(p) for f, p in given.items()}, generation.RETRY_DELAYS[:3])


def _compile(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.clean:
        compiling.wipe(spark, [args.corpus], args.pages)
    found = _pages(spark, args.pages)
    what = {"regen": args.regen, "force": args.force, "only": args.only, "max_files": args.max_files}
    if args.dry_run:
        print(compiling.to_json({"planned": compiling.plan(found, args.corpus, args.key, **what).count()}))
        return 0
    report = compiling.run(found, args.corpus, args.key, _client(args.provider), workers=args.workers, progress=lambda line: print(line, file=sys.stderr), **what)
    print(compiling.to_json(report))
    return 0


def _vectors(spark: SparkSession, path: str, n_docs: int):
    """(vectors, embedder, why not) of an index."""
    meta = vectors.load_meta(spark, f"{path}/vectors")
    if wrong := manifest.vector_errors(meta, n_docs):
        return None, None, wrong
    embedder = vectors.get_embedder(meta["model"], meta["dim"])
    rows = vectors.load(spark, f"{path}/vectors")[0].select(F.col("chunk_uid").cast("long").alias("doc_id"), "embedding")
    return (rows, embedder, []) if embedder else (None, None, [f"the model {meta['model']!r} can't be had"])


def _search(spark: SparkSession, index: ix.Index, args: argparse.Namespace) -> int:
    conf = Settings.load(args.config)
    said = read_queries(args.query, args.query_file)
    if not said:
        print("no query", file=sys.stderr)
        return 2
    for line in manifest.drift(manifest.read(spark, args.index) or {}, {"path_boost": conf.path_boost}):
        print(f"warning: {line}", file=sys.stderr)
    queries = spark.createDataFrame(list(enumerate(said)), "qid long, query string")
    mode, known, asked = args.mode or conf.mode, None, None
    if mode != "bm25":
        known, embedder, wrong = _vectors(spark, args.index, index.doc_stats.count())
        asked = vectors.encode(queries, embedder, "query", queries=True) if embedder else None
        if wrong and mode == "dense":
            print("; ".join(wrong), file=sys.stderr)
            return 2
    rerank_it = conf.rerank if args.rerank is None else args.rerank
    hits = search.search(index, queries, mode, known, asked, k=args.k or conf.final_k, bm25_k=conf.bm25_k, dense_k=conf.dense_k, rrf_k=conf.rrf_k, per_file=conf.per_file, min_should_match=conf.min_should_match, reranker=rerank.lexical_reranker if rerank_it else None)
    full = hits.join(index.docs.select("doc_id", "text"), "doc_id").join(queries, "qid")
    snip = T.snippet(F.col("text"), T.query_terms(F.col("query")), args.snippet_width)
    rows = full.select("qid", "query", "rank", "doc_id", "source", F.round("score", 4).alias("score"), snip.alias("s")).orderBy("qid", "rank").collect()  # k hits a query
    found = [{"query": r.query, "rank": r["rank"] + 1, "doc_id": r.doc_id, "source": r.source, "score": r.score, "text": r.s.snippet, "truncated": r.s.truncated} for r in rows]
    report = search.term_report(index, queries)
    if args.out:
        Path(args.out).write_text(json.dumps(found, ensure_ascii=False), encoding="utf-8")
    elif args.json:
        for hit in found:
            print(json.dumps(hit, ensure_ascii=False))
    elif args.text:
        for hit in found:
            print(f"{hit['rank']}. {hit['source']}#{hit['doc_id']} ({hit['score']})\n   {hit['text'][:200]}")
    else:
        titled = spark.createDataFrame([(r.qid, r["rank"], r.source, r.source, float(r.score), r.s.snippet) for r in rows], "qid long, rank int, title string, source string, score double, snippet string")
        shown = search.to_markdown(titled, queries, report if args.explain else None, bm25_only=mode != "bm25" and known is None)
        print("\n\n".join(r.markdown for r in shown.orderBy("qid").collect()))
    if args.explain and (args.json or args.text):
        for r in report.orderBy("qid", "at").collect():
            print(json.dumps({"qid": r.qid, "term": r.term, "df": r.df}))
    return 0


def _docs(spark: SparkSession, path: str):
    return spark.read.parquet(path).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    if args.command == "compile":
        return _compile(spark, args)
    if args.command == "audit-corpus":
        print(compiling.to_json(compiling.audit(compiling.corpus(spark, args.corpus), _pages(spark, args.pages))))
        return 0
    if args.command == "build":
        boost = Settings.load(args.config).path_boost if args.path_boost is None else args.path_boost
        try:
            print(manifest.build(_docs(spark, args.docs), args.index, args.key, {"path_boost": boost}, args.force), file=sys.stderr)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    if args.command == "vectors":
        embedder = vectors.get_embedder(args.embedder, args.dim)
        if embedder is None:
            print(f"no embedder {args.embedder!r}", file=sys.stderr)
            return 2
        chunks = _docs(spark, args.docs).select(F.col("doc_id").cast("string").alias("chunk_uid"), "text")
        print(json.dumps(vectors.build(chunks, f"{args.index}/vectors", embedder)))
        return 0
    if args.command == "serve":
        from palimpsest import server

        server.make_server(server.Loading(lambda: server.Service(spark, ix.Index.load(spark, args.index))), args.port).serve_forever()
    index = ix.Index.load(spark, args.index)
    if args.command == "status":
        out = {"documents": index.docs.count(), "terms": index.terms.count(), "postings": index.postings.count(), "manifest": manifest.read(spark, args.index)}
        if args.docs:
            out |= evaluation.coverage(index.doc_stats, _docs(spark, args.docs), "doc_id", args.prefer).first().asDict()
        print(json.dumps(out))
    elif args.command == "repl":
        from palimpsest import server

        for line in server.answer_lines(server.Service(spark, index), sys.stdin):
            print(line, flush=True)
    elif args.command == "mentions":
        rows = search.mentions(index.docs, args.term, args.limit, args.context).collect()  # limit rows
        if args.json:
            for r in rows:
                print(json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False))
        else:
            print(search.mentions_to_markdown(args.term, rows))
    else:
        return _search(spark, index, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
