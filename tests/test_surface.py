"""Compile runs, models over HTTP, vectors, manifests, the command line and the server."""

import json
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest import compiling, server
from palimpsest.config import Settings
from palimpsest.functions import reports
from palimpsest.functions import text as T
from palimpsest.operators import expand, generation, gold, index, lsh, manifest, search, vectors
from palimpsest.sources import connectors, markdown, pages, store

DOCS = [(0, "Api/Body.html", "Body.AddForce pushes a body along a vector"), (1, "Api/Body.html", "Set the mass of bodies and the drag"), (2, "Guide/a.html", "Lights and shadows of a scene"), (3, "Guide/b.html", "Sound sources and listeners")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, source string, text string")


def html_pages(spark, texts):
    rows = [(rel, f"<title>Site: {rel}</title><article><h1>{rel}</h1>{''.join(f'<p>{p}</p>' for p in t)}</article>") for rel, t in texts.items()]
    return spark.createDataFrame(rows, "rel string, html string").withColumn("md5", F.md5("html")).select("rel", "md5", "html")


# --- compile


def test_compile_goes_on_after_an_interrupt(spark, tmp_path):
    at = str(tmp_path)
    first = html_pages(spark, {f"p{i}": [f"paragraph {i} {j} with enough words to be kept" for j in range(3)] for i in range(8)})
    done = compiling.run(first, at, "k1", batches=4, stop_after=2)
    left = compiling.plan(first, at, "k1").count()
    assert done["planned"] == 8 and 0 < left < 8 and done["pages"] == 8 - left
    said = []
    assert compiling.run(first, at, "k1", batches=4, progress=said.append)["pages"] == left and len(said) == 4
    assert compiling.plan(first, at, "k1").count() == 0 and compiling.plan(first, at, "k2").count() == 8
    later = html_pages(spark, {"p1": ["another text of this page that is long enough"], "p9": ["a new page that is long enough to be kept"]})
    assert {r.rel for r in compiling.plan(later, at, "k1").collect()} == {"p1", "p9"}
    compiling.run(later, at, "k1")
    rows = compiling.corpus(spark, at)
    assert [r.text for r in rows.where("source = 'p1'").orderBy("chunk_idx").collect()] == ["## p1", "another text of this page that is long enough"]
    assert {r.rel for r in compiling.state(spark, at).collect()} == {"p1", "p9"}
    audit = compiling.audit(rows, later)
    assert audit == {"pages": 2, "without_chunks": 0, "gone": 7, "needs_regen": 0}
    compiling.store_corpus(rows, f"{at}/json")
    assert store.flatten(store.load(spark, f"{at}/json")[0]).count() == rows.count()


def test_pages_without_an_answer_are_chunked_and_done_again(spark, tmp_path):
    def broken():
        def ask(prompt):
            raise ConnectionError("down")

        return ask

    one = html_pages(spark, {"p": ["some paragraph that is long enough to be kept"]})
    out = compiling.run(one, str(tmp_path), "k", broken, batches=1)
    assert out["fallback"] == 1 and compiling.plan(one, str(tmp_path), "k").count() == 0
    assert compiling.plan(one, str(tmp_path), "k", regen=True).count() == 1
    assert compiling.corpus(spark, str(tmp_path)).first().problems.startswith("ConnectionError")


def test_generated_folders_are_wiped_only_if_they_are_apart(spark, tmp_path):
    base, good = tmp_path / "base", tmp_path / "corpus"
    for p in (base, good):
        p.mkdir()
    for bad in (str(base), str(tmp_path), "/", str(Path.cwd())):
        with pytest.raises(ValueError):
            compiling.wipe(spark, [str(good), bad], str(base))
    assert good.exists() and compiling.wipe(spark, [str(good), str(tmp_path / "none")], str(base)) == [str(good)] and not good.exists()


def test_the_local_client_drops_no_paragraph():
    page = "\n\n".join(f"paragraph {i}" for i in range(95))
    answer, wrong, calls = generation.generate_page(generation.local_client, page)
    assert not wrong and calls == 1 and "\n\n".join(c["text"] for c in answer["chunks"]) == page


def test_heuristic_flavours(spark):
    page = spark.createDataFrame([("p", "one\n\ntwo\n\n\nthree")], "source string, markdown string")
    texts = {f: [r.text for r in generation.heuristic(page, flavour=f).orderBy("chunk_idx").collect()] for f in generation.FLAVOURS}
    assert texts == {"packed": ["one\ntwo\nthree"], "paragraphs": ["one", "two", "three"], "whole": ["one\n\ntwo\n\n\nthree"]}
    with pytest.raises(ValueError):
        generation.heuristic(page, flavour="none")


# --- connectors


@pytest.fixture(scope="module")
def model():
    """A server that answers as each kind does, and fails once for /chat/completions."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, {k.lower(): v for k, v in self.headers.items()}))
            out = {
                "/chat/completions": {"choices": [{"message": {"content": "chat"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}},
                "/responses": {"output": [{"type": "reasoning"}, {"content": [{"type": "output_text", "text": "resp"}]}], "usage": {"input_tokens": 4, "output_tokens": 2}},
                "/messages": {"content": [{"type": "thinking"}, {"type": "text", "text": "mess"}], "usage": {"input_tokens": 5, "output_tokens": 3}},
                "/completion": {"content": "llama", "tokens_evaluated": 6, "tokens_predicted": 4},
            }[self.path]
            failing = body.get("model") == "busy" and sum(b.get("model") == "busy" for _, b, _ in seen) == 1
            data = json.dumps({"error": "busy"} if failing else out).encode()
            self.send_response(503 if failing else 200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    web = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", seen
    web.shutdown()


def test_connectors_speak_each_form(model):
    url, seen = model
    for kind, text, used in (("chat", "chat", (3, 1)), ("responses", "resp", (4, 2)), ("messages", "mess", (5, 3)), ("llama", "llama", (6, 4))):
        client = connectors.create(connectors.Provider(kind, "m", url, "secret", thinking=100 if kind == "messages" else None))
        assert client("hello") == text and (client.tokens_in, client.tokens_out) == used
    paths = {p: (b, h) for p, b, h in seen}
    assert paths["/responses"][0]["store"] is False and paths["/messages"][0]["thinking"]["budget_tokens"] == 100
    assert paths["/chat/completions"][1]["authorization"] == "Bearer secret" and paths["/messages"][1]["x-api-key"] == "secret"
    with pytest.raises(ValueError):
        connectors.create(connectors.Provider("smoke-signs", "m", url))


def test_failures_are_tried_again_and_pools_pass_on(model):
    url, _ = model
    slept = []
    busy = connectors.create(connectors.Provider("chat", "busy", url))
    assert generation.with_retry(lambda: busy("x"), (2, 4), slept.append) == "chat" and slept == [2]
    gone = connectors.create(connectors.Provider("chat", "m", "http://127.0.0.1:1"))
    pool = generation.pooled(lambda: {"gone": gone, "there": connectors.create(connectors.Provider("llama", "m", url))})()
    assert pool("x") == "llama" and pool.failed == {"gone": 1, "there": 0}


# --- vectors and manifests


def test_vector_builds_resume(spark, tmp_path):
    model, at = vectors.get_embedder("hash", 16), str(tmp_path / "v")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(30)], "chunk_uid string, text string")
    part = vectors.build(chunks, at, model, 4, stop_after=2)
    assert 0 < part["count"] < 30 and manifest.vector_errors(vectors.load_meta(spark, at), 30) == [f"the vectors are built in part: {part['count']} of 30"]
    with pytest.raises(ValueError):
        vectors.load(spark, at)
    assert vectors.build(chunks, at, model, 4)["count"] == 30
    changed = chunks.where("chunk_uid <> 'c3'").withColumn("text", F.when(F.col("chunk_uid") == "c5", "new").otherwise(F.col("text")))
    assert vectors.build(changed, at, model, 4)["count"] == 29
    rows, meta = vectors.load(spark, at)
    assert meta == {"model": "hash", "dim": 16, "count": 29, "normalized": True, "complete": True}
    got = {r.chunk_uid: r.embedding for r in rows.collect()}
    want = {r.chunk_uid: r.embedding for r in vectors.encode(changed, model).collect()}
    assert got == want
    assert vectors.build(changed, at, vectors.get_embedder("hash", 8), 2)["dim"] == 8 and len(vectors.load(spark, at)[0].first().embedding) == 8


def test_embedders_are_looked_for():
    assert vectors.get_embedder("none") is None and vectors.get_embedder("st", model="x") is None
    assert vectors.get_embedder("server", url="http://127.0.0.1:1") is None
    with pytest.raises(ValueError):
        vectors.get_embedder("other")


def test_queries_get_a_prefix(spark):
    given = vectors.of_function("len", 2, lambda: lambda texts: [[len(t), 0.0] for t in texts], "ask: ")
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    raw = lambda **k: {r.id: r.embedding for r in vectors.encode(rows, given, normalize=False, **k).collect()}
    assert raw() == {1: [3.0, 0.0], 2: [0.0, 0.0]} and raw(queries=True)[1] == [8.0, 0.0]
    assert {r.id: r.embedding for r in vectors.encode(rows, given).collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_manifest_does_not_depend_on_the_order(spark, docs):
    a, b = manifest.of_chunks(docs, "doc_id").first(), manifest.of_chunks(docs.orderBy(F.desc("doc_id")).repartition(3), "doc_id").first()
    assert a == b and (a.n_chunks, a.n_pages) == (4, 3)
    assert manifest.of_chunks(docs.withColumn("text", F.upper("text")), "doc_id").first().sha != a.sha
    assert manifest.of_chunks(docs.limit(0), "doc_id").first().n_chunks == 0


# --- command line and server


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("built"))
    docs.write.parquet(f"{at}/docs")
    assert cli.main(["build", "--docs", f"{at}/docs", "--index", f"{at}/index", "--key", "a"], spark) == 0
    assert cli.main(["vectors", "--docs", f"{at}/docs", "--index", f"{at}/index", "--dim", "32"], spark) == 0
    return at


def test_command_line_search_forms(spark, built, capsys, tmp_path):
    run = lambda *a: (cli.main(["search", "--index", f"{built}/index", "--query", "mass of bodies", *a], spark), capsys.readouterr().out)
    status, said = run("--explain")
    assert status == 0 and said.startswith("### mass of bodies\n1. **Api/Body.html** `Api/Body.html` score=") and "\n  > Set the mass" in said and "terms in index: " in said
    assert json.loads(run("--json")[1].splitlines()[0])["doc_id"] == 1
    assert run("--text")[1].startswith("1. Api/Body.html#1 (")
    for mode in ("dense", "hybrid"):
        assert run("--mode", mode, "--rerank")[1].startswith("### mass of bodies\n1. ")
    out = tmp_path / "hits.json"
    assert run("--out", str(out), "--k", "1", "--no-rerank") == (0, "") and len(json.loads(out.read_text())) == 1
    assert cli.main(["search", "--index", f"{built}/index"], spark) == 2


def test_command_line_guards_and_status(spark, built, capsys):
    again = lambda *a: cli.main(["build", "--docs", f"{built}/docs", "--index", f"{built}/index", *a], spark)
    assert again("--key", "a") == 0 and "up to date" in capsys.readouterr().err
    assert again("--key", "b") == 2 and "force" in capsys.readouterr().err
    assert cli.main(["status", "--index", f"{built}/index", "--docs", f"{built}/docs", "--prefer", "legacy"], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["documents"] == 4 and said["engine"] == "legacy" and said["manifest"]["gen_key"] == "a"
    assert cli.main(["mentions", "--index", f"{built}/index", "--term", "bod"], spark) == 0
    assert capsys.readouterr().out.startswith("### mentions: bod (1 files)\n- `Api/Body.html` ×3")


def test_command_line_compile(spark, tmp_path, capsys):
    html_pages(spark, {"a": ["a paragraph that is long enough to be kept"], "b": ["another paragraph that is long enough"]}).write.parquet(f"{tmp_path}/pages")
    run = lambda *a: (cli.main(["compile", "--pages", f"{tmp_path}/pages", "--corpus", f"{tmp_path}/corpus", *a], spark), json.loads(capsys.readouterr().out))
    assert run("--dry-run") == (0, {"planned": 2})
    assert run("--only", "a", "--workers", "1")[1]["pages"] == 1 and run("--max-files", "5")[1]["pages"] == 1
    assert cli.main(["audit-corpus", "--pages", f"{tmp_path}/pages", "--corpus", f"{tmp_path}/corpus"], spark) == 0
    assert json.loads(capsys.readouterr().out)["without_chunks"] == 0
    assert run("--clean")[1]["pages"] == 2


def test_server_says_that_it_is_loading(spark, docs):
    go = threading.Event()

    def load():
        go.wait(60)
        return server.Service(spark, index.build(docs))

    waiting = server.Loading(load)
    web = server.make_server(waiting)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def ask(path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(r, timeout=120) as got:
                return got.status, json.load(got)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("/health")[0] == 503 and ask("/search", {"query": "mass"})[0] == 503
    go.set()
    waiting.wait(120)
    assert ask("/health") == (200, {"status": "ok"}) and ask("/search", {"query": "mass"})[1]["hits"][0]["doc_id"] == 1
    assert ask("/read", {"source": "Api/Body.html"})[1]["text"] == "\n\n".join(t for _, s, t in DOCS if s == "Api/Body.html")
    assert ask("/read", {"source": "Api/Body.html", "max_chars": 10})[1] == {"source": "Api/Body.html", "text": DOCS[0][2][:10], "truncated": True}
    assert ask("/read", {"source": "none"})[0] == 404
    web.shutdown()
    failed = server.Loading(lambda: 1 / 0)
    failed.wait(10)
    assert failed.failed.startswith("ZeroDivisionError")


# --- the rest


def test_top_k_is_kept_before_the_shuffle(spark, docs):
    i = index.build(docs)
    queries = spark.createDataFrame([(0, "mass of bodies")], "qid long, query string")
    plan = search.bm25(i, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for part in (i.postings, i.terms, i.doc_stats):
        assert "Generate" not in part._jdf.queryExecution().executedPlan().toString()


def test_gold_sets(spark):
    rows = spark.createDataFrame([(k, f"how do I do thing number {k % 7} of this list?", "a" if k % 2 else "b") for k in range(40)], "qid long, query string, kind string")
    got = gold.extend(rows, 6, 1, "a").collect()
    assert len(got) == 1  # one prefix of five words
    more = rows.withColumn("query", F.concat(F.lit("q"), F.col("qid").cast("string"), F.col("query")))
    got = gold.extend(more, 10, 1, "a").collect()
    assert len(got) == 10 and sum(r.kind == "a" for r in got) <= 5 and got == gold.extend(more, 10, 1, "a").collect()
    with pytest.raises(ValueError):
        gold.load({"base": rows.withColumn("gold", F.array(F.lit("x")))}, "other")


def test_typos_are_found_with_expansions(spark, docs):
    i = index.build(docs)
    q = spark.createDataFrame([(0, "listeners"), (1, "shadows")], "qid long, query string")
    wrong = q.withColumn("query", gold.with_typo(F.col("query")))
    assert {r.query for r in wrong.collect()} == {"lsiteners", "sahdows"}
    near = expand.fuzzy_terms(i, search.query_tokens(wrong), 1)
    hits = {r.qid: r.doc_id for r in search.bm25(i, wrong, 1, expansions=near.select("qtoken", "term"), min_should_match=0.1).collect()}
    assert hits == {0: 3, 1: 2}


def test_bands_are_added_and_removed(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "doc_id long, h long")
    i = lsh.banded(rows)
    assert i.count() == 48
    found = {(r.qid, r.doc_id) for r in lsh.candidates(i, i).collect()}
    assert found == {(1, 2), (2, 1)}
    assert lsh.candidates(lsh.removed(i, rows.where("doc_id = 2")), i.where("doc_id = 1")).count() == 0


def test_minhash_estimates_jaccard(spark):
    a, b = "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over a lazy dog"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.minhash_jaccard(T.minhash(T.char_ngrams(F.col("a"), 3)), T.minhash(T.char_ngrams(F.col("b"), 3))).alias("v"))
    x, y = ({t[k : k + 3] for k in range(len(t) - 2)} for t in (a, b))
    assert abs(row.first().v - len(x & y) / len(x | y)) < 0.15


def test_pages_and_titles(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.html").write_text("<title>Site - Manual: A</title><div id=sidebar>side</div><svg>s</svg><p>" + "word " * 30 + "</p>")
    (tmp_path / "x/b.html").write_text("<p>short</p>")
    got = pages.load_chunks(spark, [str(tmp_path)]).collect()
    assert [r.text for r in got] == ["word " * 29 + "word"] and pages.count(spark, [str(tmp_path)]) == 2
    page = (tmp_path / "x/a.html").read_text()
    assert markdown.title_of(markdown.parse(page), r"Site\s*-\s*(?:API|Manual):\s*") == "A" and markdown.render(page) == "word " * 29 + "word"


def test_stores_replace_and_log(spark, tmp_path):
    at = f"{tmp_path}/c"
    page = lambda source, md5: (source, "", md5, "g", "", "v1", False, [("u", [], "t", "", [], [], [])])
    make = lambda *rows: spark.createDataFrame(list(rows), store.PAGE)
    store.save(make(page("a", "1"), page("b", "1")), at)
    store.replace(make(page("b", "2"), page("c", "1")), at)
    assert {(r.source, r.html_md5) for r in store.load(spark, at)[0].collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    for k in range(2):
        store.log_failures(spark.createDataFrame([(f"p{k}", "broken")], "source string, error string"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_small_things(spark, tmp_path):
    assert (reports.delay(2), reports.delay(600), reports.delay(3600), reports.duration_of(7500), reports.duration_of(187)) == ("2s", "10m", "1h", "2h05m", "3m07s")
    assert reports.progress_line(5, 10, 30, 7, "a.html", 2, 1) == "  [5/10  50.0%] 10.00 pages/min eta 30s | chunks=7 calls=2 fallback=1 | a.html"
    with pytest.raises(ValueError):
        T.tokenizer("letters")
    assert T.tokenizer("ngram") is T.char_ngrams and time.strptime(manifest.now_iso(), "%Y-%m-%dT%H:%M:%SZ")
    got = spark.range(1).select(T.relative_path(F.lit("/a//b/./c.html"), "/a/b").alias("x"), T.norm_path(F.lit(".\\x\\y")).alias("y")).first()
    assert got.y == "x/y"
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('{"dirs": ["x"], "final_k": 3}')
    b.write_text('{"dirs": ["y", "x"], "final_k": 9, "providers": [{"model": "m"}]}')
    conf = Settings.load([str(a), str(b)])
    assert (conf.dirs, conf.final_k, conf.providers) == (["x", "y"], 3, [{"model": "m"}])
