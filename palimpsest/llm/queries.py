"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, exact_dedup, html_extract, langid, license_scan, mixing, omh, pii, quality, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(_table(spark, sf_dir, "documents"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_table(spark, sf_dir, "documents"), targets=mixing.TARGETS, domain=mixing.numbered_domain(F.col("source")))
    return taken.select("doc_id", "lang", "source", "epochs")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id"])


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_license_scan": op2_license_scan,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_decontamination": op7_decontamination,
        "op8_pii": op8_pii,
        "op9_quality": op9_quality,
        "op10_order_minhash": op10_order_minhash,
        "pipeline": pipeline,
    }


#: The white space that exact deduplication deletes, as a DuckDB expression.
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"



def _weight(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {w}::double" for k, w in mixing.TARGETS[level].items()) + " else 1.0::double end"


def _shared(name: str, nodes: str, keys: list[str], parent: list[str], order: str) -> str:
    """CTEs: how the children of each parent share its budget b (columns cap, w, b)."""
    part = f"partition by {', '.join(parent)}" if parent else ""
    before = f"({part} order by r, {order} rows between unbounded preceding and 1 preceding)"
    return f"""{name}1 as (select *, case when w > 0 then cap / w else 'infinity'::double end r from {nodes}),
{name}2 as (select *, coalesce(sum(cap) over {before}, 0.0) filled, sum(w) over ({part}) - coalesce(sum(w) over {before}, 0.0) open_w from {name}1),
{name}3 as (select *, case when open_w > 1e-12 then greatest(0.0, b - filled) / open_w else 0.0 end lev from {name}2),
{name}4 as (select *, coalesce(max(case when w > 0 and lev < r then lev end) over ({part}), 'infinity'::double) tr from {name}3),
{name} as (select {", ".join(keys)}, case when w > 0 then least(cap, tr * w) else 0.0 end share from {name}4)"""


_MIX = f"""
with t as (select doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) tokens,
  case when regexp_matches(source, '[1-9][0-9]+$') then 'reference' when regexp_matches(source, '[1-9]$') then 'web' when regexp_matches(source, '0$') then 'bulk' else 'other' end as domain from documents),
leaf0 as (select domain, lang, source, sum(tokens)::double n, sum(tokens)::double * {mixing.EPOCHS} cap, {_weight("source")} w from t group by domain, lang, source),
mid0 as (select domain, lang, sum(cap) cap, {_weight("lang")} w from leaf0 group by domain, lang),
top0 as (select domain, sum(cap) cap, {_weight("domain")} w, (select sum(n) * {mixing.FRACTION} from leaf0) b from mid0 group by domain),
{_shared("top", "top0", ["domain"], [], "domain nulls first")},
mid_b as (select m.*, p.share b from mid0 m join top p on m.domain is not distinct from p.domain),
{_shared("mid", "mid_b", ["domain", "lang"], ["domain"], "lang nulls first")},
leaf_b as (select m.*, p.share b from leaf0 m join mid p on m.domain is not distinct from p.domain and m.lang is not distinct from p.lang),
{_shared("leaf", "leaf_b", ["domain", "lang", "source", "n"], ["domain", "lang"], "source nulls first")},
pl as (select *, case when n > 0 then floor((share + 1e-6) / n) else 0 end as whole from leaf),
pr as (select *, floor(round(share, 6) - whole * n + 1e-6) rest from pl),
pd as (select t.doc_id, t.lang, t.source, t.tokens, pr.domain, whole::bigint as whole, rest, ('0x' || substr(md5('{mixing.SEED}:' || whole::bigint || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint place
  from t join pr on t.domain is not distinct from pr.domain and t.lang is not distinct from pr.lang and t.source is not distinct from pr.source),
cu as (select *, sum(tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row) upto from pd),
ct as (select *, coalesce(max(case when upto <= rest then place end) over (partition by domain, lang, source), -1) cut from cu)
select doc_id, lang, source, whole + (place <= cut)::bigint as epochs from ct where whole + (place <= cut)::bigint > 0
"""

SQL = {
    "op5_mixing": _MIX,
    "op4_exact_dedup": f"""
with d as (
  select doc_id, length(coalesce(text, '')) n, sha256({_NORMAL}) h from documents
), r as (
  select *, row_number() over (partition by h order by n desc, doc_id nulls last) rn,
         first_value(doc_id) over (partition by h order by n desc, doc_id nulls last) keep_id,
         count(*) over (partition by h) group_size
  from d
)
select doc_id, keep_id, group_size, rn = 1 as kept, h as text_sha256 from r
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
