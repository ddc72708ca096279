"""Operators on small examples worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Settings, read_queries
from palimpsest.functions import text as T
from palimpsest.functions import udfs
from palimpsest.operators import evaluation, expand, fusion, generation, incremental, index, rerank, search
from palimpsest.sources import markdown, pages, store


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


DOCS = [
    (0, "Api/Rigidbody.html", "Rigidbody.AddForce pushes a body along a vector"),
    (1, "Api/Rigidbody.html", "Set the mass of bodies and the drag"),
    (2, "Guide/2d-physics.html", "Physics in two dimensions uses simpler colliders"),
    (3, "Guide/a.html", "Lights and shadows"),
    (4, "Guide/b.html", "Sound sources"),
    (5, "Guide/c.html", "Scenes and loading"),
    (6, "Guide/d.html", "Terrain tools"),
]


@pytest.fixture(scope="module")
def idx(spark):
    return index.build(spark.createDataFrame(DOCS, "doc_id long, source string, text string")).cache()


def test_words_and_terms(spark):
    got = one(spark, a=T.expand_word(F.lit("Renderer.SetPropertyBlocks")), b=T.tokenize(F.lit("The classes of HTTPServer_x2 end.")), c=T.path_terms(F.lit("Script\\Foo.BarBaz-qux.html")), d=T.expand_word(F.lit("queries")))
    assert got.a == ["renderer.setpropertyblocks", "renderer", "setpropertyblocks", "set", "property", "blocks", "rendererset", "setproperty", "propertyblocks", "renderer.setpropertyblock"]
    assert got.b == ["classes", "classe", "httpserver_x2", "http", "server", "x2", "httpserver", "serverx2", "end."]
    assert got.c[0] == "foo.barbaz-qux" and {"foo", "bar", "baz", "qux"} <= set(got.c)
    assert got.d == ["queries", "query"]


def test_normal_forms_and_grams(spark):
    got = one(spark, a=T.norm_verbatim(F.lit("A . b ( c )\n“d”")), b=T.char_ngrams(F.lit("AbcD"), 3), c=T.char_ngrams(F.lit("ab"), 3), d=T.ngram_size(F.lit("日本語 ab")), e=T.ngram_size(F.lit("abc")))
    assert (got.a, got.b, got.c, got.d, got.e) == ('A.b(c)"d"', ["abc", "bcd"], ["ab"], 2, 3)


def test_chunks_and_snippets(spark):
    text = F.lit("\n".join(f"{i}" * 30 for i in range(6)))
    chunks = one(spark, c=T.pack_paragraphs(text, 70, 10)).c
    assert chunks[0] == "0" * 30 + "\n" + "1" * 30 and chunks[1].startswith("1" * 10 + "\n" + "2" * 30) and chunks[-1].endswith("5" * 30)
    s = one(spark, s=T.snippet(F.lit("x" * 50 + "needle" + "y" * 50), F.array(F.lit("zz"), F.lit("Needle")), 20)).s
    assert "needle" in s.snippet and len(s.snippet) == 20 and s.truncated


def test_string_similarity(spark):
    got = one(
        spark, dice=T.dice(F.lit("night"), F.lit("nacht")), over=T.ngram_overlap(F.lit("night"), F.lit("nacht")), s1=T.soundex(F.lit("Ashcraft")), s2=T.soundex(F.lit("Pfister")), s3=T.soundex(F.lit("")),
        ham=T.hamming(F.lit("karolin"), F.lit("kathrin")), cos=T.sparse_cosine(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.create_map(F.lit("b"), F.lit(2.0))), dels=T.deletes(F.lit("abc"), 1),
        shard=T.shard_index(F.lit("x"), 7), imatch=T.i_match(F.array(F.lit("b"), F.lit("the"), F.lit("a"), F.lit("b"))),
    )
    assert got.dice == 0.25 and round(got.over, 6) == round(1 / 7, 6) and (got.s1, got.s2, got.s3) == ("A226", "P236", "")
    assert got.ham == 3 and round(got.cos, 6) == round(2 / 5**0.5, 6) and got.dels == ["ab", "abc", "ac", "bc"] and got.imatch == "b"
    import hashlib

    assert got.shard == int(hashlib.md5(b"x").hexdigest(), 16) % 7


def test_edit_distance_phonetics_and_stems():
    assert [udfs.osa_distance(*p) for p in (("ab", "ba"), ("ca", "abc"), ("abc", "a"), ("", "xy"))] == [1, 3, 2, 2]
    assert round(udfs.jaro_of("MARTHA", "MARHTA"), 4) == 0.9444 and udfs.jaro_of("", "a") == 0
    assert [udfs.metaphone_of(w) for w in ("Thomas", "knight", "Phone", "school", "dumb", "", "Wright", "judge", "science", "nation", "witch", "Xavier", "lamb's")] == ["0MS", "NT", "FN", "SKL", "TM", "", "RT", "JJ", "SNS", "NXN", "WX", "SFR", "LMBS"]
    assert [udfs.stem_of(w) for w in ("caresses", "ponies", "hopping", "is", "falling", "yes")] == ["caress", "poni", "hop", "is", "fall", "ye"]


def test_json_of_models():
    assert udfs.json_object('x ```json {"a": [1, {"b": 2') == {"a": [1, {"b": 2}]}
    assert udfs.json_object('```json\n{"a": "}"}\n```') == {"a": "}"} and udfs.json_object('{"a": 1,}') == {"a": 1}
    assert udfs.json_object("no") is None and udfs.json_object(None) is None and udfs.json_object("[1]") is None
    assert udfs.close_containers('{"a": "b') is None and udfs.close_containers("{]") is None


def test_search_finds_by_path_terms_and_caps_sources(spark, idx):
    q = spark.createDataFrame([(0, "rigidbody mass"), (1, "zzz"), (2, "2d physics")], "qid long, query string")
    hits = search.search(idx, q, min_should_match=0.5).collect()
    assert {(r.qid, r.doc_id) for r in hits if r.qid == 0} == {(0, 1)}  # one of each source
    assert [r.doc_id for r in hits if r.qid == 2] == [2] and not [r for r in hits if r.qid == 1]
    with pytest.raises(ValueError, match="vectors"):
        search.search(idx, q, "dense")


def test_index_round_trip(spark, idx, tmp_path):
    idx.save(str(tmp_path / "i"), 4)
    back = index.Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, idx.postings.select(back.postings.columns).collect()))


def test_fusion(spark):
    r = lambda rows: spark.createDataFrame([(0, d, s, i) for i, (d, s) in enumerate(rows)], "qid long, doc_id long, score double, rank int")
    a, b = r([(10, 9.0), (20, 8.0), (30, 7.0)]), r([(30, 0.9), (10, 0.8), (40, 0.7)])
    got = {x.doc_id: x.score for x in fusion.rrf([a, b]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {10: round(1 / 60 + 1 / 61, 9), 30: round(1 / 62 + 1 / 60, 9), 20: round(1 / 61, 9), 40: round(1 / 62, 9)}
    assert {x.doc_id: round(x.score, 9) for x in fusion.linear(a, b, 0.5).collect()} == {10: 0.75, 30: 0.5, 20: 0.25, 40: 0.0}


def test_mentions(spark, idx):
    got = search.mentions(idx.docs, "BOD", 10, 3).collect()
    assert [(r.source, r["count"]) for r in got] == [("Api/Rigidbody.html", 3)] and got[0].context
    with pytest.raises(ValueError, match="empty"):
        search.mentions(idx.docs, "")


def test_fuzzy_and_spelling(spark, idx):
    toks = spark.createDataFrame([("massx",), ("vecotr",)], "qtoken string")
    assert {(r.qtoken, r.term) for r in expand.fuzzy_terms(idx, toks, 1).collect()} == {("massx", "mass"), ("vecotr", "vector")}
    words = spark.createDataFrame([("mas",), ("mass",), ("qqqqqq",)], "word string")
    assert {r.word: r.corrected for r in expand.spell(idx, words).collect()} == {"mas": "mass", "mass": "mass", "qqqqqq": "qqqqqq"}


def test_evaluation(spark):
    hits = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "gold"), ("a", 1, 0, "gold2")], "arm string, qid long, rank int, source string")
    gold = spark.createDataFrame([(0, ["gold"]), (1, ["gold2", "no"]), (2, ["z"])], "qid long, gold array<string>")
    r = evaluation.evaluate(hits, gold).first()
    assert (r.mrr, r.hit_1, r.hit_3, r.recall_3) == (0.5, round(1 / 3, 6), round(2 / 3, 6), 0.5)
    assert evaluation.gate(evaluation.evaluate(hits, gold), F.lit(0.94)).first().verdict == "DEFER"
    graded = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 1, 2), (0, 3, 2, 0), (1, 1, 0, 0)], "qid long, doc_id long, rank int, rel int")
    assert {x.qid: x.ndcg for x in evaluation.ndcg(graded).collect()} == {0: 1.0, 1: 0.0}


def test_rerankers(spark):
    c = spark.createDataFrame([(0, 1, 1.0, ["a", "b"]), (0, 2, 0.9, ["a", "b"]), (0, 3, 0.5, ["c"])], "qid long, doc_id long, score double, tokens array<string>")
    assert [r.doc_id for r in rerank.mmr(c, 0.5).orderBy("place").collect()] == [1, 3, 2]
    assert [r.doc_id for r in rerank.xquad(c.withColumnRenamed("tokens", "aspects"), 0.6).orderBy("place").collect()] == [1, 3, 2]
    rng = np.random.default_rng(0)
    x, group = rng.normal(size=(60, 3)), np.repeat(np.arange(6), 10)
    y = (x[:, 1] > 0).astype(float)
    for w in (rerank.coordinate_ascent(x, y, group), rerank.rank_svm(x, y, group)):
        assert np.abs(w).argmax() == 1 and w[1] > 0
    stumps = rerank.rank_boost(x, y, group)
    assert stumps and stumps[0][0] == 1


def test_incremental(spark):
    f = lambda rows: spark.createDataFrame(rows, "rel string, md5 string")
    d = incremental.diff(f([("a", "1"), ("b", "2"), ("d", "4")]), f([("a", "1"), ("b", "x"), ("c", "3")]))
    assert {r.rel: r.status for r in d.collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    stored = spark.createDataFrame([("b",)], "rel string")
    assert sorted(r.rel for r in incremental.plan_work(d, stored).collect()) == ["a", "b", "d"]
    assert incremental.plan_work(d, stored, only="a").count() == 1 and incremental.plan_work(d, stored, force=True, max_files=2).count() == 2
    with pytest.raises(ValueError, match="no such page"):
        incremental.plan_work(d, stored, only="c")


def test_generation(spark):
    rows = spark.createDataFrame([("p", "First para.\n\nSecond para.")], "source string, markdown string")
    assert [r.text for r in generation.generate(rows).orderBy("chunk_idx").collect()] == ["First para.", "Second para."]
    bad = generation.generate(rows, lambda: lambda prompt: '{"chunks": [{"text": "made up"}]}').collect()
    assert bad[0].needs_regen and bad[0].calls == 4 and "isn't in the page" in bad[0].problems
    assert generation.heuristic(rows).first().needs_regen


def test_retries_and_providers():
    class Busy(Exception):
        status_code = 429

    waits, left = [], [Busy(), Busy(), "ok"]

    def call():
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert generation.with_retry(call, sleep=waits.append) == "ok" and waits == [2, 4]
    with pytest.raises(KeyError):
        generation.with_retry(lambda: {}["x"], sleep=waits.append)
    now = [0.0]

    def broken(_):
        raise TimeoutError

    pool = generation.ProviderPool({"a": broken, "b": lambda p: "b"}, failures=2, rest=10, clock=lambda: now[0])
    assert [pool("x"), pool("x")] == ["b", "b"] and pool.available() == ["b"]
    now[0] = 11
    assert pool.available() == ["a", "b"]


def test_markdown_and_scan(spark, tmp_path):
    page = "<title>T</title><div id='content-wrap'><h1>Head</h1><div class='sig-block'>void F()</div><p>Body <b>bold</b><p>Body <b>bold</b><ul><li>x<li>y</ul><table><tr><th>a<th>b<tr><td>1<td>2</table><p>Cookies</p></div>"
    assert markdown.render(page) == "## Head\n\n```\nvoid F()\n```\n\nBody bold\n\n- x\n\n- y\n\n| a | b |\n\n| --- | --- |\n\n| 1 | 2 |"
    assert markdown.title_of(markdown.parse("<h1> A  b</h1>")) == "A b"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.html").write_text(page)
    (tmp_path / "d/b.txt").write_text("no")
    assert pages.count(spark, [str(tmp_path / "d"), str(tmp_path / "none")]) == 1


def test_store_sets_corrupt_rows_aside(spark, tmp_path):
    good = {"source": "a", "title": "", "chunks": [{"chunk_uid": "u", "heading_path": ["h"], "text": "ü", "qa": [{"q": "x", "a": "y"}]}]}
    (tmp_path / "x.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"source": "b", "chunks": []}) + "\n")
    rows, bad = store.load(spark, str(tmp_path / "x.json"))
    assert [r.source for r in rows.collect()] == ["a", "b"] and bad.count() == 1
    flat = store.flatten(rows).collect()
    assert [(r.source, r.text, r.qa[0].q) for r in flat] == [("a", "ü", "x")]


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"final_k": 3}')
    (tmp_path / "b.json").write_text('{"final_k": 9, "rrf_k": 7, "other": 1}')
    s = Settings.load([str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert (s.final_k, s.rrf_k, s.mode) == (3, 7, "bm25")
    (tmp_path / "q").write_text("# no\n\n one \n")
    assert read_queries([" x ", ""], str(tmp_path / "q")) == ["x", "one"]


def test_command_line(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    spark.createDataFrame(DOCS, "doc_id long, source string, text string").write.parquet(str(tmp_path / "docs"))
    assert main(["build", "--docs", str(tmp_path / "docs"), "--index", str(tmp_path / "i")], spark) == 0
    assert main(["search", "--index", str(tmp_path / "i"), "--query", "rigidbody mass", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["doc_id"] == 1
    assert main(["search", "--index", str(tmp_path / "i")], spark) == 2


def test_service(spark, idx):
    import threading
    import urllib.error
    import urllib.request

    from palimpsest.server import Service, answer_lines, make_server

    service = Service(spark, idx)
    out = [json.loads(x) for x in answer_lines(service, ['{"query": "rigidbody mass", "k": 1}', "", "{bad", '{"read": "Guide/a.html"}', '{"read": "none"}', '{"mentions": "bod"}', "{}"])]
    assert out[0]["hits"][0]["doc_id"] == 1 and "error" in out[1] and out[2]["text"].startswith("Lights") and "error" in out[3] and out[4]["sources"][0]["count"] == 3 and "error" in out[5]
    web = make_server(service)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{web.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"{url}/health")) == {"status": "ok"}
    post = lambda path, body: urllib.request.urlopen(urllib.request.Request(url + path, json.dumps(body).encode()))
    assert json.load(post("/search", {"query": "terrain"}))["hits"][0]["doc_id"] == 6
    for path, body, status in (("/search", {"no": 1}, 400), ("/x", {}, 404), ("/read", {"source": "none"}, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(path, body)
        assert e.value.code == status
    web.shutdown()
