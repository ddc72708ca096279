"""The DataFrame-only operators against brute force and on hard cases."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontam, exact_dedup, license_scan, mixing, pii, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, lang="en", source="src0"):
    return spark.createDataFrame([(i, t, lang, source, None) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls in every column, repeated rows, empty and long texts."""
    rows = [(1, "a b", "en", "src0", 3), (1, "a b", "en", "src0", 3), (None, None, None, None, None), (2, "", "de", "src1", 0), (3, "word " * 30000, "en", None, 1), (4, "x" * 50000, None, "src0", 1), (5, "\n \t", "en", "src0", 3), (6, "a  b", "fr", "src0", 4)]
    return spark.createDataFrame(rows, DOCS)


# --- exact dedup


def test_exact_dedup_keeps_longest_then_smallest_id(spark):
    got = {r.doc_id: r for r in exact_dedup.assign(frame(spark, ["ab c", "a b c", "abc", "x", None, " "])).collect()}
    assert [got[i].keep_id for i in range(6)] == [1, 1, 1, 3, 5, 5]
    assert got[1].kept and not got[0].kept and got[0].group_size == 3
    assert got[3].text_sha256 == hashlib.sha256(b"x").hexdigest()


def test_exact_dedup_index_persists_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    assert exact_dedup.deduplicate(frame(spark, ["a", "b", "a"]), index).count() == 2
    second = exact_dedup.deduplicate(frame(spark, ["b ", "c", "c "]), index).collect()
    assert [r.text for r in second] == ["c "]
    assert spark.table(index.table).count() == 3
    assert {r.group_size for r in index.groups().collect()} == {2}
    # A session that doesn't know the tables finds them by their path.
    spark.sql(f"DROP TABLE {index.table}")
    spark.sql(f"DROP TABLE {index.copies}")
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 4 and spark.table(again.table).count() == 3
    assert [r.text for r in exact_dedup.deduplicate(frame(spark, ["a", "d", "c"]), again).collect()] == ["d"]
    assert sum(r.group_size for r in again.groups().collect()) == 9
    again.drop()
    assert not again.exists()


def test_exact_dedup_batches_agree_with_one_pass(spark):
    texts = [("x " * (i % 7) + "y" * (i % 5)) for i in range(300)]
    got = exact_dedup.assign(frame(spark, texts)).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.replace(" ", "")].append((-len(t), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want


def test_exact_dedup_of_odd_rows(spark):
    docs = odd(spark).withColumnRenamed("n_chars", "digest")
    rows = exact_dedup.assign(docs).collect()
    assert len(rows) == 8 and sum(r.kept for r in rows) == 4
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert exact_dedup.assign(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


# --- license scan


def brute_scan(text):
    w = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = frame(spark, ["Under the MIT-License, (CC) by CC BY cc.by", "mit license mit license", "GNU general\npublic  LICENSE gnu general public gnu general public license", "apache", "", None, "©mit license", "licensed under the Apache Licence"])
    for d in (docs, extra, odd(spark)):
        want = sorted(((r.doc_id, *brute_scan(r.text)) for r in d.collect()), key=str)
        rows = license_scan.scan(d).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
        assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_notice_survives_a_dropped_word(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"
    assert license_scan.scan(frame(spark, [text])).first().labels == "mit-notice"


def test_license_notice_of_doubled_words_is_none(spark):
    notice = dict(license_scan.NOTICES)["bsd-notice"]
    doubled = " ".join(f"{w} {w}" for w in notice.split())
    apart = " ".join(f"{w} x" if i % 2 else w for i, w in enumerate(notice.split()))
    got = {r.doc_id: r.labels for r in license_scan.scan(frame(spark, [notice, doubled, apart])).collect()}
    assert got == {0: "bsd-notice", 1: "", 2: ""}


def test_license_labels_differ_by_version_and_qualifier(spark):
    want = {
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY 4.0, nc 3": "cc-by,cc-by-4.0",
        "Licensed under CC BY-ND 4.0": "cc-by",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "This work is licensed under the GNU General Public License, version 1.": "gpl",
        "licensed under the GNU Lesser General Public License version 3": "lgpl",
        "Licensed under the Apache License, Version 2": "apache,apache-2.0",
        "Licensed under the Apache License, Version 2.1": "apache",
        # All pairs of a notice, but in the wrong order.
        "copy modify and x permission to use y to use copy z or distribute this software": "",
        "universal 1 0 universal cc0 1 0 under cc0 1 domain under cc0 public domain under the public domain to the public dedicated to the": "",
    }
    got = {r.doc_id: r.labels for r in license_scan.scan(frame(spark, list(want))).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


# --- decontamination


def test_decontamination_finds_copies_and_other_numbers(spark):
    bench = spark.createDataFrame([(7, "A train leaves at 5 hours and drives 60 km with 5 stops before it turns back home"), (8, "short one")], "item_id long, text string")
    docs = frame(
        spark,
        [
            "He said: a train leaves at 5 hours and drives 60 km with 5 stops before it turns back home, then.",
            "A train leaves at 9 hours and drives 75 km with 9 stops before it turns back home",
            "A train leaves at 9 hours and drives 75 km with 8 stops before it turns back home",
            "A train leaves a station and nothing happens to it at all on this day or another",
            None,
            "short one",
        ],
    )
    got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert [got[i].contaminated for i in range(6)] == [True, True, False, False, False, False]
    assert got[0].item_ids == "7" and got[0].coverage == 1.0
    clean = decontam.decontaminate(docs.withColumnRenamed("n_chars", "text_key"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(odd(spark), bench).count() == 8


def test_decontamination_finds_copies_whose_names_look_otherwise(spark):
    text = "In which year did the river near Paris flood the old town of Lyon for 12 days"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = [
        text.lower(),
        text.upper(),
        text.replace("near ", "near\n").replace("of ", "of  "),
        text.replace("Paris", "(Paris)").replace("Lyon", '"Lyon"'),
        text.lower().replace("12", "15"),
        text.replace("near Paris", "near\nRome").replace("Lyon", "Ostia"),
        text.replace("Paris", "Rome").replace("Lyon", "Rome"),
        text.lower().replace("paris", "the harbour").replace("lyon", "wood"),
    ]
    got = {r.doc_id: r.contaminated for r in decontam.report(frame(spark, docs), bench).collect()}
    assert [got[i] for i in range(8)] == [True] * 6 + [False] * 2


def test_decontamination_checks_slots_over_all_diagonals(spark):
    text = "A train leaves at 5 hours and drives 60 km with 5 stops before it turns back home to the small old town by the sea where all the people of the valley wait for it"
    names = "the painter Maria Lopez bought 3.5 pounds of blue paint from the old shop near the harbour"
    numbers = " ".join(str(x) for x in range(200))
    bench = spark.createDataFrame([(1, text), (2, names), (3, numbers)], "item_id long, text string")
    docs = {
        text.replace("5 hours", "9 hours").replace("drives", "then drives").replace("5 stops", "9 stops"): True,
        text.replace("5 hours", "9 hours").replace("drives", "then drives").replace("5 stops", "7 stops"): False,
        names.replace("3.5", "12").replace("Maria Lopez", "Peter"): True,
        names.replace("3.5", "12").replace("Maria Lopez", "Anna Maria Smith"): True,
        " ".join(str(x * 7) for x in range(3000)): False,
        "some days, some feet and some seconds are not units here": False,
        # The windows of the item, far apart.
        " ".join(" ".join(text.split()[i : i + 5]) + " x" * 50 for i in range(12)): False,
    }
    got = {r.doc_id: r.contaminated for r in decontam.report(frame(spark, list(docs)), bench).collect()}
    assert [got[i] for i in range(len(docs))] == list(docs.values())


def test_decontamination_equals_brute_force(spark, sf):
    bench, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "documents"))
    items = {r.item_id: WORD.findall(r.text.lower()) for r in bench.collect()}
    k = decontam.WINDOW
    wins = {i: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] for i, w in items.items()}
    want = set()
    for r in docs.collect():
        w = WORD.findall((r.text or "").lower())
        have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        want |= {r.doc_id for x in wins.values() if x and sum(y in have for y in x) >= 0.8 * len(x)}
    got = {r.doc_id for r in decontam.report(docs, bench).where("contaminated").collect()}
    assert got == want and want


# --- PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def brute_pii(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text or ""):
            n = sum(c.isdigit() for c in m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= n <= 19 and luhn(m[0]) % 10 == 0, "phone": 10 <= n <= 15}[k]:
                out.append((m.start(), list(BASE).index(k), m.end(), k))
    return sorted(out)


HARD = [
    "a@b.com_x@d.org and me@x, you@y.z. ..@-.- é@ü.de a@b@c.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.0000255 1.2.3 1..2.3.4 12.34.56.78.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000 0000 0000 00 1 2 3",
    "+1 (555) 123-4567 +1 555 ++4912345678901) +1 (((( +123456789012345678",
    "x@" + "a." * 3000 + "b 1" * 5, "1" * 3000 + " " + "a.b-" * 3000, "", None, "😀 joe@x.org 😀 10.0.0.1 ü",
]


def test_pii_equals_brute_force(spark, sf):
    for d in (frame(spark, HARD), spark.read.parquet(f"{sf}/documents.parquet"), odd(spark)):
        text = sorted(((r.doc_id, brute_pii(r.text)) for r in d.collect()), key=str)
        rows = sorted(pii.report(d).collect(), key=lambda r: str((r.doc_id, r.n_email)))
        want = sorted(((i, *[sum(s[3] == k for s in spans) for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()) for i, spans in text), key=str)
        assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=str) == want
    assert pii.report(frame(spark, HARD).limit(0)).count() == 0


def test_pii_terms_that_give_an_entity_away(spark):
    texts = ["the plumber Zarquon writes from joe@x.org about pipes"] * 3 + [f"the plumber was here and there about pipes {i}" for i in range(60)]
    rows = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    said = [p.split(":") for p in rows[0].spans.split(",")]
    assert ["term", "12", "19"] in said and ["email", "32", "41"] in said
    assert not any(texts[0][int(a) : int(b)] == "plumber" for _, a, b in said)
    assert rows[5].spans == ""


def test_pii_terms_are_marked_wherever_they_stand(spark):
    far = " ".join(["and so on it went about pipes"] * 20)
    texts = [f"Zarquon's day\n{far} zarquon writes from joe@x.org about pipes {far} éZarquon ZARQUON"] * 3
    texts += ["ümlaut: Zarquon was here"] + [f"the plumber was here and writes from there about pipes {i}" for i in range(60)]
    rows = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    for i in (0, 2, 3):
        spans = [p.split(":") for p in rows[i].spans.split(",")]
        said = [int(a) for k, a, b in spans if k == "term" and texts[i][int(a) : int(b)].lower() == "zarquon"]
        assert said == [m.start() for m in re.finditer("(?<!é)zarquon", texts[i].lower())]
    assert rows[9].spans == ""


def test_pii_texts_are_sanitised(spark):
    texts = ["Zarquon! The plumber Zarquon writes from joe@x.org (10.0.0.1) about pipes"] * 3 + [f"the plumber was here and writes from there about pipes {i}" for i in range(60)]
    texts += [" ".join(f"a{i}@b{i}.org" for i in range(500)), "call +1 555 123 4567.", None, "", "4111 1111 1111 1111, +4111 1111 1111 1111!"]
    docs = frame(spark, texts).withColumnRenamed("n_chars", "clean_key")
    got = pii.sanitised(docs)
    assert got.columns == docs.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[0] == text[1] == "! The plumber  writes from <email> (<ip>) about pipes"
    assert text[5] == texts[5] and text[63] == " ".join(["<email>"] * 500) and text[64] == "call <phone>."
    # A card that also is a phone number is covered whole.
    assert text[65] is None and text[66] == "" and not re.search("[0-9]", text[67])
    kept = {r.doc_id: r.text for r in pii.sanitised(docs, remove=1.1).collect()}
    assert kept[0] == "<term>! The plumber <term> writes from <email> (<ip>) about pipes"


def test_pii_is_linear_in_the_matches(spark):
    text = " ".join(f"a{i}@b{i}.org" for i in range(20000))
    r = pii.report(frame(spark, [text])).first()
    assert r.n_email == 20000 and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_pii(text)).encode()).hexdigest()


def test_pii_weighs_shorter_terms_if_told(spark):
    texts = ["Ann: joe@x.org about pipes"] * 3 + [f"about pipes {i}" for i in range(60)]
    marked = lambda **p: "term:0:3" in pii.report(frame(spark, texts), **p).where("doc_id = 0").first().spans
    assert not marked() and marked(length=3)


# --- mixing


def brute_share(budget, nodes):
    """nodes: {key: (weight, capacity)}; hand out, fill, hand the rest out again."""
    got, open_, left = dict.fromkeys(nodes, 0.0), set(nodes), budget
    while open_ and left > 1e-9:
        total = sum(nodes[k][0] for k in open_)
        if total <= 0:
            break
        lam = left / total
        full = {k for k in open_ if got[k] + lam * nodes[k][0] >= nodes[k][1]}
        for k in full or open_:
            give = (nodes[k][1] - got[k]) if full else lam * nodes[k][0]
            got[k] += give
            left -= give
        open_ -= full or open_
    return got


def brute_mix(rows, fraction, epochs, seed, targets=None, domain=lambda s: None if s is None else re.sub("[0-9]+$", "", s)):
    leaves = defaultdict(list)
    for r in rows:
        leaves[(domain(r.source), r.lang, r.source)].append((r.doc_id, len(re.findall(r"[^ \t\n\r\f]+", r.text or ""))))
    n = {k: sum(t for _, t in v) for k, v in leaves.items()}
    cap = lambda pre: sum(epochs * n[k] for k in n if k[: len(pre)] == pre)
    shares = {(): fraction * sum(n.values())}
    for depth in range(3):
        for p in [p for p in shares if len(p) == depth]:
            kids = {k[: depth + 1] for k in n if k[:depth] == p}
            of = (targets or {}).get(mixing.LEVELS[depth], {})
            shares |= brute_share(shares[p], {c: (of.get(c[-1], 1.0), cap(c)) for c in kids})
    out = {}
    for k, docs in leaves.items():
        b = round(shares[k], 6)
        full = int((b + 1e-6) // n[k]) if n[k] else 0
        rest = int(b - full * n[k] + 1e-6)
        place = lambda d: int(hashlib.md5(f"{seed}:{full}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        tot, cut = 0, -1
        by = defaultdict(int)
        for d, t in docs:
            by[place(d)] += t
        for at in sorted(by):
            tot += by[at]
            if tot > rest:
                break
            cut = at
        for d, _ in docs:
            if (c := full + (place(d) <= cut)) > 0:
                out[(k, d)] = c
    return out


@pytest.mark.parametrize(("fraction", "epochs"), [(0.5, 2), (1.4, 2), (3, 1)])
def test_mixing_equals_brute_force(spark, sf, fraction, epochs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, odd(spark)):
        got = mixing.mix(d, fraction=fraction, epochs=epochs)
        have = {((None if r.source is None else re.sub("[0-9]+$", "", r.source), r.lang, r.source), r.doc_id): r.epochs for r in got.collect()}
        assert have == brute_mix(d.collect(), fraction, epochs, mixing.SEED)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_to_the_targets_of_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def domain(source):
        number = int(m[0]) if source and (m := re.search("[0-9]+$", source)) else None
        return "other" if number is None else "bulk" if number == 0 else "web" if number < 10 else "reference"

    for d in (docs, odd(spark)):
        want = brute_mix(d.collect(), mixing.FRACTION, mixing.EPOCHS, mixing.SEED, mixing.TARGETS, domain)
        got = mixing.mix(d, targets=mixing.TARGETS, domain=mixing.numbered_domain(F.col("source"))).collect()
        assert {((domain(r.source), r.lang, r.source), r.doc_id): r.epochs for r in got} == want
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"planet": {}})


def test_mixing_leaves_without_a_weight_get_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "a1", None), (2, "c d", "en", None, None), (3, "e f", "en", "a2", None)], DOCS)
    weights = spark.createDataFrame([("a", "en", "a1", 1.0)], "domain string, lang string, source string, weight double")
    assert [r.doc_id for r in mixing.mix(docs, weights, fraction=2.0).collect()] == [1]


def test_mixing_weights_and_shortage(spark):
    rows = [(i, "w " * 10, "en", "a1" if i < 50 else "a2", None) for i in range(52)] + [(100 + i, "w " * 10, "de", "b1", None) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("a", "en", "a1", 1.0), ("a", "en", "a2", 1.0), ("b", "de", "b1", 2.0)], "domain string, lang string, source string, weight double")
    plan = {r.source: r.budget for r in mixing.cuts(docs, weights, fraction=400 / 1020, epochs=1).collect()}
    assert plan == {"a1": 180.0, "a2": 20.0, "b1": 200.0}  # the sibling takes a2's shortage
    assert "epochs" in mixing.mix(docs, weights).columns
    assert mixing.mix(docs.withColumn("epochs", docs.n_chars), weights).columns[-1] == "_epochs"


def test_natives_on_null_ids_repeats_and_clashing_columns(spark):
    text = "A train leaves at 5 hours and drives 60 km with 5 stops before it turns back home. Licensed under CC BY 4.0, ask joe@x.org"
    rows = [(None, text, None, None, None), (None, text, None, None, None), (9007199254740993, text, "en", "src1", 1), (9007199254740993, text, "en", "src1", 1), (3, None, "en", "src1", 1), (4, "", None, "src1", 1), (5, "clean", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("row", "key", "near", "base", "w", "g", "digest", "domain", "text_key"):
        docs = docs.withColumn(name, F.lit(name))
    bench = spark.createDataFrame([(None, text.split(".")[0]), (2, None)], "item_id long, text string")
    ids = sorted((str(r.doc_id) for r in docs.collect()))
    got = decontam.report(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ids and sum(r.contaminated for r in got) in (0, 4)
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    for rows in (license_scan.scan(docs).collect(), pii.report(docs).collect(), exact_dedup.assign(docs).collect()):
        assert sorted(str(r.doc_id) for r in rows) == ids
    assert sum(r.n_base for r in license_scan.scan(docs).collect()) == 4 and sum(r.n_email for r in pii.report(docs).collect()) == 4
    assert exact_dedup.deduplicate(docs).count() == 3 and exact_dedup.deduplicate(docs).columns == docs.columns
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).count() == 7
    assert mixing.mix(docs, targets=mixing.TARGETS).columns == [*docs.columns, "epochs"]
