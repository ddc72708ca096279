"""License scans by diagonal voting.

All rolling word pairs of every text are joined to the places of the same pairs
in license templates. A hit at document word p and template word t votes for the
diagonal p - t. Votes are added up by (document, template, diagonal),
neighbouring diagonals are merged, so that a dropped or added word doesn't break
a match. Places with enough votes are verified: their pairs are aligned with the
template in order, and the words that tell licenses apart (numbers, where the
template has any, and QUALIFIERS) must be the template's in the template's order.
A number 0 may be missing or added, as version 2 is version 2.0.

Defined cases: a null text counts as empty and has no words; an empty table
gives an empty result; rows that repeat a doc_id are scanned one by one; extra
columns are ignored. Words longer than any template word simply never match.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, words

# Phrases and the labels they stand for.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Public license notices, as words, and their labels.
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "released under the mit license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a notice's word pairs that must be found, and how far diagonals may drift.
COVERAGE, DRIFT = 0.8, 2
#: Words that make another license of a notice ("library" does so after "gnu" only).
QUALIFIERS = ["nc", "sa", "nd", "lesser", "affero"]
#: Bits of the filter that word pairs pass before the join (64 in each long).
_BITS = 4096


def _telling(w: list[str]) -> list[str]:
    """The words of a template that tell it from others, in order."""
    return [x for i, x in enumerate(w) if (x < ":" and x != "0") or x in QUALIFIERS or (x == "library" and i and w[i - 1] == "gnu")]


def templates(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """A row for each pair of neighbouring words of a template."""
    rows = [{"tpl": i, "label": label, "base": base, "words": text.split(), "marks": _telling(text.split())} for i, (label, text, base) in enumerate([(k, t, True) for k, t in (PHRASES if phrases is None else phrases)] + [(k, t, False) for k, t in (NOTICES if notices is None else notices)])]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<tpl:int,label:string,base:boolean,words:array<string>,marks:array<string>>>")))
    w = F.col("words")
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(i.alias("tpos"), F.get(w, i).alias("t1"), F.get(w, i + 1).alias("t2")))
    return table.where(F.size(w) >= 2).select("tpl", "label", "base", "marks", (F.size(w) - 1).alias("m"), F.inline(pairs)).withColumn("pair", F.xxhash64("t1", "t2"))


def _passes(h: Column, bits: Column) -> Column:
    at = F.pmod(h, F.lit(_BITS)).cast("int")
    return F.getbit(F.get(bits, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1


def _chains(places: DataFrame) -> DataFrame:
    """Of each place the runs of pairs that follow the template in order.

    A pair continues a run if it lies further on in both, at most DRIFT diagonals
    from the pair before and at most DRIFT, or a share of 1 - COVERAGE of the
    template, from the run's first. Only pairs near enough to be continued are kept, and ends of
    long enough runs.
    """
    m = F.col("m")
    pairs = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(h.found, lambda t: F.struct((h.diag + t).alias("pos"), t.alias("tpos"))))))

    def step(acc: Column, x: Column) -> Column:
        before = F.filter(acc, lambda a: (a.pos < x.pos) & (a.tpos < x.tpos) & (F.abs(x.pos - x.tpos - a.pos + a.tpos) <= DRIFT) & (F.abs(x.pos - x.tpos - a.start) <= F.greatest(F.lit(DRIFT), m * (1 - COVERAGE))))
        best = F.array_max(F.transform(before, lambda a: F.struct(a.n.alias("n"), a.start.alias("start"))))
        new = F.transform(
            F.array(best),
            lambda b: F.struct(x.pos.alias("pos"), x.tpos.alias("tpos"), (F.coalesce(b.n, F.lit(0)) + 1).alias("n"), F.coalesce(b.start, x.pos - x.tpos).alias("start")),
        )
        return F.concat(F.filter(acc, lambda a: (a.pos >= x.pos - m - DRIFT) | (a.n / m >= COVERAGE)), new)

    runs = F.aggregate(pairs, F.expr("cast(array() as array<struct<pos:int,tpos:int,n:int,start:int>>)"), step)
    return (
        places.select("row", "tpl", "label", "m", "marks", F.inline(F.filter(runs, lambda a: a.n / m >= COVERAGE)))
        .groupBy("row", "tpl", "label", "m", "marks", "start")
        .agg(F.max(F.struct("n", (F.col("pos") + m - F.col("tpos")).alias("last"))).alias("end"))
        .select("row", "label", "marks", F.col("start").alias("diag"), (F.col("end.n") / m).alias("share"), F.lit(False).alias("base"), F.col("end.last").alias("last"))
    )


def _verified(span: Column, marks: Column) -> Column:
    """The telling words of a text's span are those of the template."""
    numbers = F.exists(span.marks, lambda x: x < ":")
    here = F.filter(marks, lambda k: (k.pos >= span.start) & (k.pos <= span.last) & (numbers | (k.word >= ":")))
    return span.base | (F.transform(here, lambda k: k.word) == span.marks)


def scan(docs: DataFrame, phrases=None, notices=None) -> DataFrame:
    """A row for each document: its words, base hits, labels and score."""
    spark = docs.sparkSession
    tpl = templates(spark, phrases, notices)
    # The templates are constants of the code: a few hundred pairs.
    table = [0] * (_BITS // 64)
    for (h,) in tpl.select("pair").distinct().collect():
        at = h % _BITS
        table[at // 64] |= 1 << (at % 64)
    bits = F.array(*[F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long") for x in table])
    pairs = F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("w1"), F.get("w", i + 1).alias("w2")))
    near = F.filter(pairs, lambda p: p.w2.isNotNull() & _passes(F.xxhash64(p.w1, p.w2), bits))
    telling = lambda p: ((p.w1 < ":") & (p.w1 != "0")) | p.w1.isin(QUALIFIERS) | ((p.w1 == "library") & (F.get("w", p.pos - 1) == "gnu"))
    marks = F.transform(F.filter(pairs, lambda p: F.coalesce(telling(p), F.lit(False))), lambda p: F.struct(p.pos.alias("pos"), p.w1.alias("word")))
    seen = materialize(
        docs.select("doc_id", words(F.col("text")).alias("w"))
        .select("doc_id", F.size("w").cast("long").alias("n_words"), near.alias("near"), marks.alias("marks"))
        .withColumn("row", F.monotonically_increasing_id()),
        "license",
    )
    hits = (
        seen.select("row", F.inline("near"))
        .withColumn("pair", F.xxhash64("w1", "w2"))
        .join(F.broadcast(tpl), "pair")
        .where((F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")))
        .select("row", "tpl", "label", "base", "marks", "m", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))
    )
    votes = hits.groupBy("row", "tpl", "label", "base", "marks", "m", "diag").agg(F.collect_set("tpos").alias("found"))
    # Base phrases: every pair on one diagonal, so the words stand as they are.
    base = votes.where(F.col("base") & (F.size("found") == F.col("m"))).select("row", "label", "marks", "diag", F.lit(1.0).alias("share"), F.lit(True).alias("base"), (F.col("diag") + F.col("m")).alias("last"))
    # Notices: diagonals that differ by a word or two belong to one place.
    order = W.partitionBy("row", "tpl").orderBy("diag")
    merged = (
        votes.where(~F.col("base"))
        .withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(order) > DRIFT).cast("int"), F.lit(1)))
        .withColumn("place", F.sum("new").over(order))
        .groupBy("row", "tpl", "label", "marks", "m", "place")
        .agg(F.collect_list(F.struct("diag", "found")).alias("hits"))
        .where(F.size(F.array_distinct(F.flatten("hits.found"))) / F.col("m") >= COVERAGE)
    )
    spans = base.unionByName(_chains(merged))
    of = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("diag").alias("start"), "last", "label", "share", "base", "marks"))).alias("all"))
    none = F.expr("cast(array() as array<struct<start:int,last:int,label:string,share:double,base:boolean,marks:array<string>>>)")
    rows = seen.drop("near").join(of, "row", "left").withColumn("good", F.filter(F.coalesce("all", none), lambda x: _verified(x, F.col("marks"))))
    hits = F.filter("good", lambda x: x.base)
    join = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x.label))), ",")
    plain = F.transform("good", lambda x: F.struct(x.start.alias("start"), x.last.alias("last"), x.label.alias("label"), x.share.alias("share")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(hits).cast("long").alias("n_base"),
        F.array_min(F.transform(hits, lambda x: x.start)).cast("long").alias("first_word"),
        F.array_max(F.transform(hits, lambda x: x.start)).cast("long").alias("last_word"),
        join(hits).alias("base_labels"),
        join(F.col("good")).alias("labels"),
        F.coalesce(F.array_max(F.transform("good", lambda x: x.share)), F.lit(0.0)).alias("score"),
        F.when(F.size("good") > 0, plain).alias("spans"),
    )
