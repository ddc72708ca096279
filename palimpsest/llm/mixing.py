"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A token budget is handed down the tree: at each
node the children share it in proportion to their weights, and what a child can't
use (its tokens times the allowed epochs) goes to its siblings before anything
returns to an ancestor. Each leaf then takes whole epochs of its documents and a
token-prefix of one more, in an order seeded for each epoch.

Shares: with children of weight w and capacity c under budget b, each gets
min(c, l * w) where l makes the sum min(b, sum of c). Sorted by c / w, l follows
from running sums, so that a level is one window over its nodes.

Weights are given by leaf, as a table, or by level, as TARGETS: there a child that
isn't named weighs 1.

Prefixes: a leaf's documents are spread over buckets by their seeded order, the
buckets' tokens are summed, and only the documents of the bucket in which the
prefix ends are looked at one by one. No window holds a whole leaf.

Defined cases: a null text has no tokens and, as it costs nothing, is taken
whenever its place in the order comes before the cut; null domain, lang or source
are a leaf of their own; a leaf that a table of weights doesn't name weighs 0 and gets
nothing; rows that repeat a doc_id share a place in the order and
are taken or left together; an empty table gives an empty result; extra columns
pass through mix().
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, materialize

#: Share of all tokens to select, epochs at most, and the seed of the order.
FRACTION, EPOCHS, SEED = 0.5, 2, 17
#: Documents that a bucket of a leaf's order should hold.
BUCKET_ROWS = 2000
#: Buckets by the leading hex digits of the order's 60 bits.
_SPAN = 1 << 60
LEVELS = ["domain", "lang", "source"]
#: Target weights of the query and the pipeline, for the domains of numbered_domain().
TARGETS = {
    "domain": {"bulk": 2.0, "web": 3.0, "reference": 4.0, "other": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src1": 2.0, "src10": 2.0},
}


def order_of(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A place in the order of an epoch: 60 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def tokens_of(text: Column) -> Column:
    """Words between spaces and line breaks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f]+")).cast("long")


def domain_of(source: Column) -> Column:
    """The default domain: the source's name without its number."""
    return F.regexp_replace(source, "[0-9]+$", "")


def numbered_domain(source: Column) -> Column:
    """A domain by the source's number: 0 is bulk, 1 to 9 are web, the rest is reference."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    named = F.when(number.rlike("^0+$"), "bulk").when(number.rlike("^0*[1-9]$"), "web").when(number != "", "reference")
    return F.coalesce(named, F.lit("other"))


def _target(targets: dict[str, dict[str, float]] | None, level: str) -> Column:
    """The weight that targets give to a child of this level, or 1."""
    if not (targets or {}).get(level):
        return F.lit(1.0)
    table = F.from_json(F.lit(json.dumps(targets[level])), "map<string,double>")
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(1.0))


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds share: each node's part of its parent's budget (columns budget, weight, capacity)."""
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = w.orderBy("ratio", *[c for c in LEVELS if c in nodes.columns and c not in parent]).rowsBetween(W.unboundedPreceding, -1)
    inf = F.lit(float("inf"))
    sums = (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(inf))
        .withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # The level if all smaller nodes are full and no larger one is. It is the true
    # one at the first node above it, and lower at all nodes after that.
    level = F.when(F.col("open") > 1e-12, F.greatest(F.lit(0.0), F.col("budget") - F.col("full")) / F.col("open")).otherwise(F.lit(0.0))
    sums = sums.withColumn("level", level)
    true = F.coalesce(F.max(F.when((F.col("weight") > 0) & (F.col("level") < F.col("ratio")), F.col("level"))).over(w), inf)
    part = F.when(F.col("weight") > 0, F.least("capacity", true * F.col("weight"))).otherwise(F.lit(0.0))
    return sums.withColumn("share", part).drop("ratio", "full", "open", "level")


def _same(left: DataFrame, right: DataFrame, prefix: str, keys: list[str]) -> Column:
    """left's keys equal right's prefixed ones, nulls included."""
    out = F.lit(True)
    for c in keys:
        out = out & left[c].eqNullSafe(right[f"{prefix}{c}"])
    return out


def budgets(leaves: DataFrame, weights: DataFrame | None, fraction: float, epochs: int, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Leaves with columns n_tokens, budget (double), epochs_full and rest.

    weights: (domain, lang, source, weight) of leaves, which add up to their
    ancestors' weights; without it children weigh what targets say.
    """
    if unknown := set(targets or {}) - set(LEVELS):
        raise ValueError(f"no such level: {sorted(unknown)}")
    leaves = leaves.withColumn("capacity", F.col("n_tokens").cast("double") * epochs)
    if weights is None:
        leaves = leaves.withColumn("weight", _target(targets, "source"))
    else:
        given = weights.groupBy(*LEVELS).agg(F.max("weight").cast("double").alias("weight")).select(*[F.col(c).alias(f"w_{c}") for c in LEVELS], "weight")
        leaves = leaves.join(given, _same(leaves, given, "w_", LEVELS), "left").drop(*[f"w_{c}" for c in LEVELS]).fillna({"weight": 0.0})
    by_leaf = weights is not None
    mid = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), (F.sum("weight") if by_leaf else F.first(_target(targets, "lang"))).alias("weight"))
    top = mid.groupBy("domain").agg(F.sum("capacity").alias("capacity"), (F.sum("weight") if by_leaf else F.first(_target(targets, "domain"))).alias("weight"))
    whole = leaves.agg((F.coalesce(F.sum("n_tokens"), F.lit(0)) * F.lit(fraction)).alias("budget"))
    top = share(top.crossJoin(F.broadcast(whole)), [])  # one row: the budget of the root
    mid = _down(mid, top, ["domain"])
    out = _down(leaves, mid, ["domain", "lang"])
    n = F.col("n_tokens")
    full = F.when(n > 0, F.floor((F.col("share") + 1e-6) / n)).otherwise(F.lit(0)).cast("long")
    return out.select(*LEVELS, "n_tokens", "n_docs", F.round("share", 6).alias("budget"), full.alias("epochs_full")).withColumn("rest", F.floor(F.col("budget") - F.col("epochs_full") * F.col("n_tokens") + 1e-6).cast("long"))


def _down(nodes: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    p = parents.select(*[F.col(c).alias(f"p_{c}") for c in keys], F.col("share").alias("budget"))
    return share(nodes.join(p, _same(nodes, p, "p_", keys)).drop(*[f"p_{c}" for c in keys]), keys)


def cuts(docs: DataFrame, weights: DataFrame | None = None, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """A row for each leaf: its budget, whole epochs and cut.

    A document of the leaf is taken epochs_full times, and once more if its place
    in the order of epoch epochs_full is at most cut.
    """
    rows = docs.select((domain_of(F.col("source")) if domain is None else domain).alias("domain"), "lang", "source", "doc_id", tokens_of(F.col("text")).alias("tokens"))
    rows = materialize(rows, "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = materialize(budgets(leaves, weights, fraction, epochs, targets), "plan")
    small = plan.select(*[F.col(c).alias(f"l_{c}") for c in LEVELS], "epochs_full", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long").alias("n_buckets"))
    placed = rows.join(small, _same(rows, small, "l_", LEVELS)).withColumn("place", order_of(F.col("doc_id"), F.col("epochs_full"), seed)).withColumn("bucket", F.floor(F.col("place") / (F.lit(_SPAN) / F.col("n_buckets"))).cast("long"))
    keys = [f"l_{c}" for c in LEVELS]
    sums = placed.groupBy(*keys, "rest", "bucket").agg(F.sum("tokens").alias("t"), F.max("place").alias("top"))
    # One row for each bucket of a leaf, thousands of documents each.
    run = W.partitionBy(*keys).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("t").over(run))
    ends = sums.groupBy(*keys, "rest").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("top"))).alias("whole_top"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")))).alias("open"),
    )
    ends = materialize(ends, "ends")
    edge = ends.where(F.col("open").isNotNull()).select(*[F.col(k).alias(f"e{k}") for k in keys], F.col("rest").alias("e_rest"), F.col("open.bucket").alias("bucket"), F.col("open.before").alias("before"))
    inside = placed.join(edge, _same(placed, edge, "e", keys) & (placed.bucket == edge.bucket)).select(*keys, "e_rest", "before", "place", "tokens").groupBy(*keys, "e_rest", "before", "place").agg(F.sum("tokens").alias("tokens"))
    run = W.partitionBy(*keys).orderBy("place")
    inner = inside.withColumn("upto", F.sum("tokens").over(run) + F.col("before")).where(F.col("upto") <= F.col("e_rest")).groupBy(*keys).agg(F.max("place").alias("inner_top"))
    inner = inner.select(*[F.col(k).alias(f"i{k}") for k in keys], "inner_top")
    joined = ends.join(inner, _same(ends, inner, "i", keys), "left")
    cut = joined.select(*[F.col(k).alias(f"c{k[1:]}") for k in keys], F.coalesce(F.greatest("inner_top", "whole_top"), F.lit(-1)).cast("long").alias("cut"))
    done = plan.join(cut, _same(plan, cut, "c_", LEVELS))
    return materialize(done.drop(*[f"c_{c}" for c in LEVELS]), "cuts")


def mix(docs: DataFrame, weights: DataFrame | None = None, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The documents taken, with a column epochs: how often each is used."""
    leaf = cuts(docs, weights, fraction, epochs, seed, domain, targets)
    names = free_name(docs, "m_domain", "m_lang", "m_source", "m_full", "m_cut", "m_of")
    side = leaf.select(*[F.col(c).alias(n) for c, n in zip([*LEVELS, "epochs_full", "cut"], names, strict=False)])
    d, lang, s, full, cut, own = names
    tagged = docs.withColumn(own, domain_of(F.col("source")) if domain is None else domain)
    joined = tagged.join(side, F.col(own).eqNullSafe(F.col(d)) & F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(s)))
    (out,) = free_name(docs, "epochs")
    n = F.col(full) + (order_of(F.col("doc_id"), F.col(full), seed) <= F.col(cut)).cast("long")
    return joined.withColumn(out, n.cast("long")).where(F.col(out) > 0).select(*docs.columns, out)
