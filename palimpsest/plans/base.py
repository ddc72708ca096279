"""What the queries share: tables, the index of documents, and SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import index, search

_kept: dict[tuple, object] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, sf: str, what: str, make):
    """One cached value for each session, input and name: an index is built once, not once a query."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(keep: tuple[str, ...] = ()) -> None:
    """Drop cached values but those of the names to keep."""
    for key in [k for k in _kept if k[2] not in keep]:
        value = _kept.pop(key)
        if isinstance(value, DataFrame):
            value.unpersist()


def doc_index(spark: SparkSession, sf: str) -> index.Index:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return once(spark, sf, "index", lambda: index.build(docs).cache())


def bench_queries(spark: SparkSession, sf: str, words: int = 6) -> DataFrame:
    """(qid, query): the first words of each benchmark passage."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, words), " ").alias("query"))


def bm25_hits(spark: SparkSession, sf: str, k: int = 200) -> DataFrame:
    return once(spark, sf, f"hits{k}", lambda: search.bm25(doc_index(spark, sf), bench_queries(spark, sf), k).cache())


# --- SQL (DuckDB)
WORD_RE = T.WORD
STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + "]"


def parts_sql(w: str) -> str:
    """Parts of an identifier, without lookahead."""
    x = f"regexp_replace({w}, '[^A-Za-z0-9]', ' ', 'g')"
    for pattern in ("([A-Z]+)([A-Z][a-z])", "([a-z0-9])([A-Z])", "([A-Z])([0-9])"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower({x}), ' '), lambda p: p <> '')"


def expand_cte(source: str) -> str:
    """CTEs dw, de and ex(word, l, terms) for the distinct words of a relation with a column word."""
    return f"""
dw as (select word, lower(word) lw, {parts_sql("word")} p from (select distinct word from {source})),
de as (select word, list_concat([lw],
    case when regexp_matches(lw, '^.+\\.[^.]+$') then [regexp_extract(lw, '^(.+)\\.([^.]+)$', 1), regexp_extract(lw, '^(.+)\\.([^.]+)$', 2)] else []::varchar[] end,
    case when len(p) > 1 then list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1])) else []::varchar[] end,
    case when lw like '%ies' and len(lw) > 4 then [lw[:-4] || 'y'] when lw like '%s' and lw not like '%ss' and len(lw) > 3 then [lw[:-2]] else []::varchar[] end) l from dw),
ex as (select word, list_filter(l, lambda a, i: list_position(l, a) = i) l, list_filter(list_filter(l, lambda a, i: list_position(l, a) = i), lambda t: len(t) >= 2 and not list_contains({STOP}, t)) terms from de)"""


#: Queries, and the index with its pruned terms: q, qt, postings, terms, doc_stats, coll.
INDEX = f"""
words as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) word from documents),
q as (select item_id qid, array_to_string(string_split(text, ' ')[1:6], ' ') query from benchmark),
qw as (select qid, unnest(regexp_extract_all(query, '{WORD_RE}')) word from q),
vocab as (select word from words union select word from qw union select source from documents where source is not null),
{expand_cte("vocab")},
wc as (select doc_id, word, count(*) n from words group by all),
tf as (select doc_id, term, sum(n)::bigint tf from (
    select doc_id, unnest(terms) term, n from wc join ex using (word)
    union all select doc_id, term, 3 from (select doc_id, unnest(terms) term from documents join ex on source = word) where len(term) > 2) group by all),
doc_stats as (select doc_id, coalesce(sum(tf), 0)::bigint dl from (select doc_id from documents) left join tf using (doc_id) group by 1),
coll as (select max(doc_id) + 1 n, avg(dl) avgdl, sum(dl)::bigint total from doc_stats),
terms as (select term, df, cf from (select term, count(*) df, sum(tf)::bigint cf from tf group by 1), coll where df <= n * 0.5),
postings as (select tf.* from tf join terms using (term)),
qt as (select distinct qid, unnest(terms) term from qw join ex using (word))"""

#: On top of INDEX: bm25(qid, doc_id, score, rank), best 200.
BM25 = f"""{INDEX},
need as (select qid, greatest(1, ceil(count(*) * 0.6)) need from qt group by 1),
have as (select qid, count(*) have from qt join terms using (term) group by 1),
able as (select qid, need from need join have using (qid) where have >= need),
scored as (select qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) score, count(*) matched, any_value(need) need
    from qt join able using (qid) join terms using (term) join postings using (term) join doc_stats using (doc_id), coll group by qid, doc_id),
bm25 as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) - 1 rank from scored where matched >= need) where rank < 200)"""


def with_(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body}"
