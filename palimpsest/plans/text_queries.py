"""Queries of text functions, scans and projections (T, P, F, X, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.plans.base import STOP, WORD_RE, expand_cte, parts_sql, table, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_docs = lambda s, d: table(s, d, "documents")


def _text():
    return F.coalesce("text", F.lit(""))


_WORDS = f"words as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) pos from (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') ws from documents))"


@query("t1_tokenize", with_(f"{_WORDS}, {expand_cte('words')}", "select doc_id, coalesce(string_agg(array_to_string(terms, ' '), ' ' order by pos) filter (len(terms) > 0), '') tokens from documents left join words using (doc_id) left join ex using (word) group by doc_id"))
def t1(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.tokenize(_text()), " ").alias("tokens"))


@query("t2_expand_word", with_(f"{_WORDS}, {expand_cte('words')}", "select word, array_to_string(l, ' ') terms from ex"))
def t2(s, d):
    words = _docs(s, d).select(F.explode(T.raw_words(_text())).alias("word")).distinct()
    return words.select("word", F.array_join(T.expand_word(F.col("word")), " ").alias("terms"))


@query("t3_split_identifier", with_(_WORDS, f"select distinct word, array_to_string({parts_sql('word')}, ' ') parts from words"))
def t3(s, d):
    words = _docs(s, d).select(F.explode(T.raw_words(_text())).alias("word")).distinct()
    return words.select("word", F.array_join(T.split_identifier(F.col("word")), " ").alias("parts"))


@query("t4_query_terms", with_(f"words as (select item_id, unnest(ws) word, generate_subscripts(ws, 1) pos from (select item_id, regexp_extract_all(text, '{WORD_RE}') ws from benchmark)), {expand_cte('words')}, f as (select item_id, term, min(pos * 100 + i) k from (select item_id, pos, unnest(terms) term, generate_subscripts(terms, 1) i from words join ex using (word)) group by all)", "select item_id, string_agg(term, ' ' order by k) terms from f group by item_id"))
def t4(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


_STEM = r"regexp_replace(regexp_extract(replace(url, '\', '/'), '[^/]*$'), '(?i)\.(html?|md)$', '')"


@query("t5_path_terms", with_(f"""st as (select page_id, {_STEM} stem from pages),
pc as (select page_id, unnest(ps) piece, generate_subscripts(ps, 1) k from (select page_id, list_filter(list_concat([stem], string_split(stem, '-'), string_split(stem, '.')), lambda x: x <> '') ps from st)),
vocab as (select piece word from pc), {expand_cte("vocab")},
sp as (select piece, {parts_sql("piece")} p from (select distinct piece from pc)),
al as (select page_id, k, unnest(list_concat(l, p)) term, generate_subscripts(list_concat(l, p), 1) i from pc join ex on piece = word join sp using (piece)),
f as (select page_id, term, min(k * 1000 + i) o from al where len(term) > 2 and not list_contains({STOP}, term) group by all)""", "select page_id, coalesce(string_agg(term, ' ' order by o), '') terms from pages left join f using (page_id) group by page_id"))
def t5(s, d):
    return table(s, d, "pages").select("page_id", F.array_join(T.path_terms(F.col("url")), " ").alias("terms"))


@query("t6_stopwords", f"select unnest({STOP}) word")
def t6(s, d):
    return s.range(1).select(F.explode(F.array(*[F.lit(w) for w in T.STOPWORDS])).alias("word"))


@query("t8_ngram_size", "select doc_id, case when len(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]', '', 'g')) * 10 > len(text) * 3 then 2 else 3 end n from documents")
def t8(s, d):
    return _docs(s, d).select("doc_id", T.ngram_size(F.col("text")).alias("n"))


@query("t9_char_ngrams", "with b as (select item_id, lower(text) t from benchmark) select item_id, case when len(t) <= 3 then t else array_to_string(list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2]), '|') end grams from b")
def t9(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(T.char_ngrams(F.col("text")), "|").alias("grams"))


_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("t10_norm_ws", f"select doc_id, md5({_NORM}) h from documents")
def t10(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.norm_ws(_text())).alias("h"))


@query("t10_norm_verbatim", "select doc_id, md5(translate(regexp_replace(" + _NORM + r", '\s*([.,;:()\[\]{}])\s*', '\1', 'g'), '“”‘’«»', '""''''""')) h from documents")
def t10v(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.norm_verbatim(_text())).alias("h"))


# --- scans and sinks


@query("s1_page_scan", "select page_id, url, md5(html) md5 from pages")
def s1(s, d):
    return table(s, d, "pages").select("page_id", "url", F.md5("html").alias("md5"))


@query("s2_page_count", "select count(*) n from pages")
def s2(s, d):
    return table(s, d, "pages").agg(F.count(F.lit(1)).alias("n"))


@query("s3_page_cap", "select page_id, len(html) char_len, case when len(html) > 2000 then html[:2000] || chr(10) || '[... page truncated: ' || (len(html) - 2000) || ' more chars not shown ...]' else html end as body from pages where len(regexp_replace(html, '\\s', '', 'g')) >= 30")
def s3(s, d):
    from palimpsest.sources.pages import cap

    p = table(s, d, "pages").where(F.length(F.regexp_replace("html", r"\s", "")) >= 30)
    return p.select("page_id", F.length("html").cast("long").alias("char_len"), cap(F.col("html"), 2000).alias("body"))


@query("s14_query_source", "select item_id, trim(line) as query from (select item_id, unnest(string_split(text, chr(10))) line from benchmark) where trim(line) <> '' and trim(line) not like '#%'")
def s14(s, d):
    lines = table(s, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("item_id", T.strip(F.col("line")).alias("query")).where((F.col("query") != "") & ~F.col("query").startswith("#"))


# --- projections

_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query("p2_raw_title", f"select page_id, {_TITLE} title from pages")
def p2(s, d):
    return table(s, d, "pages").select("page_id", T.strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query("p6_strip_boilerplate", "select doc_id, md5(coalesce(string_agg(line, chr(10) order by i) filter (trim(line) <> '' and not regexp_matches(trim(line), '^(Released under the .*|Licensed under .*|This work is licensed .*)$')), '')) h from (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from (select doc_id, string_split(text, chr(10)) ls from documents)) group by doc_id")
def p6(s, d):
    patterns = ["Released under the .*", "Licensed under .*", "This work is licensed .*"]
    return _docs(s, d).select("doc_id", F.md5(T.strip_boilerplate(F.col("text"), patterns)).alias("h"))


def chunks(s, d):
    c = _docs(s, d).select("doc_id", "source", F.posexplode(T.pack_paragraphs(_text())).alias("chunk_idx", "text"))
    return c.withColumn("chunk_uid", T.chunk_uid(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("chunk_idx")))


@query("p7_chunk_text")
def p7(s, d):
    return chunks(s, d)


@query("p7_single_paragraphs", "select doc_id, trim(text) chunk from documents where text not like '%' || chr(10) || '%' and trim(text) <> ''")
def p7b(s, d):
    one = _docs(s, d).where(~F.col("text").contains("\n"))
    return one.select("doc_id", F.explode(T.pack_paragraphs(F.col("text"))).alias("chunk"))


@query("p8_index_text", "select doc_id, array_to_string(list_filter([source, lang, text, 'n' || n_chars, source || '-x'], lambda x: x is not null and x <> ''), chr(10)) t from documents")
def p8(s, d):
    parts = T.index_text(F.col("source"), F.array("lang"), F.col("text"), F.concat(F.lit("n"), F.col("n_chars").cast("string")), F.array(F.concat("source", F.lit("-x"))))
    return _docs(s, d).select("doc_id", parts.alias("t"))


@query("p9_embed_text", "select doc_id, array_to_string(list_filter([source, lang, text], lambda x: x is not null and x <> ''), chr(10)) t from documents")
def p9(s, d):
    return _docs(s, d).select("doc_id", T.index_text(F.col("source"), F.array("lang"), F.col("text")).alias("t"))


@query("p11_snippet", """with c as (select doc_id, text, list_filter(list_transform(['zzzz', 'worthless', 'then', 'que', 'der'], lambda t: strpos(lower(text), t)), lambda p: p > 0)[1] - 1 pos from documents),
w as (select *, least(len(text), greatest(0, pos - 60) + 120) hi from c)
select doc_id, trim(case when pos is null then text[:120] else substr(text, greatest(0, hi - 120) + 1, hi - greatest(0, hi - 120)) end, chr(32) || chr(10)) snippet, case when pos is null then len(text) > 120 else greatest(0, hi - 120) > 0 or hi < len(text) end truncated from w""")
def p11(s, d):
    terms = F.array(*[F.lit(t) for t in ("zzzz", "worthless", "then", "que", "der")])
    return _docs(s, d).select("doc_id", T.snippet(_text(), terms, 120).alias("s")).select("doc_id", "s.snippet", "s.truncated")


@query("p13_chunk_uid", "select doc_id, substr(sha1(source || '#' || doc_id), 1, 16) uid, md5(text) md5, substr(sha1(text), 1, 8) short from documents")
def p13(s, d):
    return _docs(s, d).select("doc_id", T.chunk_uid(F.col("source"), F.col("doc_id")).alias("uid"), F.md5("text").alias("md5"), F.substring(F.sha1("text"), 1, 8).alias("short"))


# --- predicates


@query("f6_verbatim", r"with p as (select doc_id, text, text[11:60] c from documents) select doc_id, contains(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s*([.,;:()\[\]{}])\s*', '\1', 'g'), regexp_replace(trim(regexp_replace(c, '\s+', ' ', 'g')), '\s*([.,;:()\[\]{}])\s*', '\1', 'g')) ok from p")
def f6(s, d):
    return _docs(s, d).select("doc_id", F.contains(T.norm_verbatim(F.col("text")), T.norm_verbatim(F.substring("text", 11, 50))).alias("ok"))


@query("f8_tiny_filter", "select doc_id from documents where len(trim(text)) >= 50")
def f8(s, d):
    return _docs(s, d).where(F.length(F.trim("text")) >= 50).select("doc_id")


# --- scalar functions

_PAIRS = "pr as (select a.item_id a_id, b.item_id b_id, lower(string_split(a.text, ' ')[1]) a, lower(string_split(b.text, ' ')[2]) b from benchmark a join benchmark b on b.item_id between a.item_id and a.item_id + 5)"


def _pairs(s, d):
    b = table(s, d, "benchmark")
    first = b.select(F.col("item_id").alias("a_id"), F.lower(F.get(F.split("text", " "), F.lit(0))).alias("a"))
    second = b.select(F.col("item_id").alias("b_id"), F.lower(F.get(F.split("text", " "), F.lit(1))).alias("b"))
    return first.withColumn("b_id", F.explode(F.sequence(F.col("a_id"), F.col("a_id") + 5))).join(second, "b_id")


@query("x2_auto_fuzziness", f"with {_PAIRS} select a_id, b_id, case when len(a) <= 2 then 0 when len(a) <= 5 then 1 else 2 end e from pr")
def x2(s, d):
    return _pairs(s, d).select("a_id", "b_id", T.auto_fuzziness(F.col("a")).alias("e"))


@query("x3_deletes", f"with {_PAIRS} select a_id, b_id, array_to_string(list_sort(list_distinct(list_concat([a], list_transform(range(1, len(a) + 1), lambda i: substr(a, 1, i - 1) || substr(a, i + 1))))), ',') d from pr where a <> ''")
def x3(s, d):
    return _pairs(s, d).where("a <> ''").select("a_id", "b_id", F.array_join(T.deletes(F.col("a"), 1), ",").alias("d"))


_GRAMS = "case when len({0}) = 0 then []::varchar[] when len({0}) <= 2 then [{0}] else list_distinct(list_transform(range(1, len({0})), lambda i: substr({0}, i, 2))) end"


@query("x9_dice", f"with {_PAIRS}, g as (select *, {_GRAMS.format('a')} x, {_GRAMS.format('b')} y from pr) select a_id, b_id, round(case when len(x) + len(y) = 0 then 0 else 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) end, 6) v from g")
def x9(s, d):
    return _pairs(s, d).select("a_id", "b_id", F.round(T.dice(F.col("a"), F.col("b")), 6).alias("v"))


@query("x10_ngram_overlap", f"with {_PAIRS}, g as (select *, {_GRAMS.format('a')} x, {_GRAMS.format('b')} y from pr) select a_id, b_id, round(case when len(x) + len(y) = 0 then 0 else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end, 6) v from g")
def x10(s, d):
    return _pairs(s, d).select("a_id", "b_id", F.round(T.ngram_overlap(F.col("a"), F.col("b")), 6).alias("v"))


@query("x11_token_jaccard", "with t as (select item_id, list_distinct(string_split(lower(text), ' ')) w from benchmark) select a.item_id a_id, b.item_id b_id, round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))), 6) v from t a join t b on b.item_id between a.item_id and a.item_id + 5")
def x11(s, d):
    w = table(s, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    a = w.select(F.col("item_id").alias("a_id"), F.col("w").alias("x"), F.explode(F.sequence("item_id", F.col("item_id") + 5)).alias("b_id"))
    return a.join(w.select(F.col("item_id").alias("b_id"), F.col("w").alias("y")), "b_id").select("a_id", "b_id", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("v"))


@query("x12_hamming", f"with {_PAIRS} select a_id, b_id, hamming(rpad(a, 8, '-'), rpad(b, 8, '-'))::int v from pr where regexp_matches(a || b, '^[a-z.,]*$')")
def x12(s, d):
    return _pairs(s, d).where(F.concat("a", "b").rlike("^[a-z.,]*$")).select("a_id", "b_id", T.hamming(F.rpad("a", 8, "-"), F.rpad("b", 8, "-")).cast("int").alias("v"))


@query("x14_soundex")
def x14(s, d):
    words = _docs(s, d).select(F.explode(T.raw_words(_text())).alias("word")).distinct()
    return words.select("word", T.soundex(F.col("word")).alias("code"))


@query("x21_i_match", f"with t as (select item_id, list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: not list_contains({STOP}, w)))) w from benchmark) select item_id, array_to_string(w, ' ') f from t")
def x21(s, d):
    return table(s, d, "benchmark").select("item_id", T.i_match(F.split(F.lower("text"), " ")).alias("f"))


@query("x27_shard_index", "with h as (select doc_id, string_split(md5(doc_id::varchar), '') c from documents) select doc_id, list_reduce(list_prepend(0::bigint, list_transform(list_filter(c, lambda x: x <> ''), lambda x: (strpos('0123456789abcdef', x) - 1)::bigint)), lambda acc, x: (acc * 16 + x) % 7)::bigint shard from h")
def x27(s, d):
    return _docs(s, d).select("doc_id", T.shard_index(F.col("doc_id").cast("string"), 7).alias("shard"))


@query("x29_format_duration", "select doc_id, case when n_chars < 60 then n_chars || 's' when n_chars < 3600 then (n_chars // 60) || 'm' || lpad((n_chars % 60)::varchar, 2, '0') || 's' else (n_chars // 3600) || 'h' || lpad(((n_chars % 3600) // 60)::varchar, 2, '0') || 'm' end t from documents")
def x29(s, d):
    from palimpsest.functions.reports import duration

    return _docs(s, d).select("doc_id", duration(F.col("n_chars")).alias("t"))


@query("x31_relative_path", r"select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') rel from pages")
def x31(s, d):
    return table(s, d, "pages").select("page_id", T.url_path(F.col("url")).alias("rel"))


@query("x18_simhash")
def x18(s, d):
    return table(s, d, "benchmark").select("item_id", T.simhash(F.split("text", r"\s+")).alias("h"))


@query("x20_minhash")
def x20(s, d):
    sig = T.minhash(T.char_ngrams(F.col("text"), 3))
    return table(s, d, "benchmark").select("item_id", F.array_join(F.transform(sig, lambda x: x.cast("string")), ",").alias("sig"))
