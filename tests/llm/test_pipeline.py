"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import mixing
from palimpsest.llm.common import materialize
from tests.llm.test_free import brute_classes
from tests.llm.test_native import DOCS, WORD, brute_mix, odd


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, sf), "test")
        after = docs.collect()
        kept = {r.doc_id for r in after}
        assert kept <= {r.doc_id for r in before}
        if name == "quality classifier":
            known = [r for r in before if r.doc_id in labels]
            good = [r.doc_id for r in known if labels[r.doc_id].quality and not labels[r.doc_id].toxic]
            bad = [r.doc_id for r in known if not labels[r.doc_id].quality]
            assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
        elif name == "exact dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
                best[key] = min(best.get(key, (0, r.doc_id)), (-len(r.text), r.doc_id)) if key in best else (-len(r.text), r.doc_id)
            assert kept == {i for _, i in best.values()}
        elif name == "order MinHash near-dedup":
            assert kept == set(brute_classes([(r.doc_id, r.text) for r in before]).values())
        elif name == "benchmark decontamination":
            bad = set()
            for r in before:
                w = WORD.findall(r.text.lower())
                have = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
                for b in bench:
                    wins = [tuple(b[j : j + 5]) for j in range(len(b) - 4)]
                    if wins and sum(x in have for x in wins) >= 0.8 * len(wins):
                        bad.add(r.doc_id)
            assert kept == {r.doc_id for r in before} - bad
        else:
            want = brute_mix(before, mixing.FRACTION, mixing.EPOCHS, mixing.SEED, mixing.TARGETS, number_domain)
            assert {r.doc_id: r.epochs for r in after} == {k[1]: v for k, v in want.items()}
            assert docs.columns == [*columns, "epochs"]
            continue
        assert docs.columns == columns


def test_run_of_odd_rows(spark, tmp_path):
    more = spark.createDataFrame([(9 + i, f"the quick brown fox number {i} jumps over the lazy dog of the old farmer near the river", "en", "src1", 5) for i in range(40)], DOCS)
    docs = odd(spark).unionByName(more).withColumn("epochs", F.lit("x")).withColumn("kept", F.lit(None).cast("int"))
    labels = spark.createDataFrame([(9 + i, int(i % 4 > 0), 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f g"), (2, "")], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        table.write.parquet(f"{tmp_path}/full/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert out.columns == [*docs.columns, "_epochs"]
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.epochs == "x" and r._epochs > 0 for r in rows)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def number_domain(source):
    number = int(m[0]) if source and (m := re.search("[0-9]+$", source)) else None
    return "other" if number is None else "bulk" if number == 0 else "web" if number < 10 else "reference"


def test_run_gives_the_last_stage(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).columns[-1] == "epochs"
