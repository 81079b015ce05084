"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .registry import query, table


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM documents
""")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.normalise_space(F.col("text")).alias("text"))


@query()
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.number_tokens(F.col("text"))).alias("pos", "token"))
    ok = C.has_value(F.col("token"))
    return rows.select("doc_id", "pos", "token", ok.alias("has_value"), F.when(ok, C.canonical_decimal(C.plain_number(F.col("token")))).alias("value"))


@query("""
WITH q AS (SELECT item_id, string_split(text, '.')[1] AS q FROM benchmark)
SELECT doc_id, item_id, CAST((length(text) - length(replace(text, q, ''))) // length(q) AS BIGINT) AS n
FROM documents JOIN q ON length(q) > 20 AND contains(text, q)
""")
def quote_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each benchmark item's first sentence stands in each document."""
    from ..operators.quotes import quote_hits

    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", r"\.")[0].alias("q")).filter(F.length("q") > 20)
    return quote_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), quotes, "item_id", "q").select("doc_id", "item_id", "n")


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passage_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quotes import quote_hits

    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    return quote_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), items, "item_id", "q").select("doc_id").distinct()


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)) AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.url_host(F.col("url")).alias("host"))


@query("""
WITH s AS (SELECT doc_id, text, length(text) // 3 AS a, least(length(text), length(text) // 3 + 20) AS b FROM documents)
SELECT doc_id, substr(text, greatest(a - 32, 0) + 1, a - greatest(a - 32, 0)) AS prefix, substr(text, a + 1, b - a) AS exact,
       substr(text, b + 1, 32) AS suffix, CAST(strlen(substr(text, 1, a)) AS INTEGER) AS start_byte FROM s
""")
def text_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    s = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(n / 3).cast("int").alias("a"), F.least(n, F.floor(n / 3).cast("int") + 20).alias("b"))
    prefix, exact, suffix = C.text_selector(F.col("text"), F.col("a"), F.col("b"))
    return s.select("doc_id", prefix.alias("prefix"), exact.alias("exact"), suffix.alias("suffix"), C.byte_offset(F.col("text"), F.col("a")).alias("start_byte"))


@query("""
SELECT r_regionkey, 'sha256:' || sha256('evidora/1:region' || chr(0) || '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS digest FROM region
""")
def json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"r_name":"'), "r_name", F.lit('","r_regionkey":'), F.col("r_regionkey").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "region").select("r_regionkey", C.digest("region", body).alias("digest"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'thousand' WHEN 1 THEN 'million' WHEN 2 THEN 'billion' WHEN 3 THEN 'trillion' WHEN 4 THEN 'lakh' ELSE 'dollars' END AS w,
  o_orderkey % 997 AS n FROM orders)
SELECT o_orderkey, n AS value, CASE w WHEN 'thousand' THEN n * 1000 WHEN 'million' THEN n * 1000000 WHEN 'billion' THEN n * 1000000000 WHEN 'trillion' THEN n * 1000000000000 WHEN 'lakh' THEN n * 100000 ELSE -1 END AS scaled FROM t
""")
def scale_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.element_at(F.array(*(F.lit(w) for w in ("thousand", "million", "billion", "trillion", "lakh", "dollars"))), (k % 6 + 1).cast("int"))
    text = F.concat(F.lit("Order total "), (k % 997).cast("string"), F.lit(" "), words, F.lit(" net"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    number = F.regexp_extract("text", r"(?<![\p{L}\p{N}.,])([0-9]+)", 1).cast("long")
    power = F.create_map(*(x for w, p in C.SCALES.items() for x in (F.lit(w), F.lit(10**p).cast("long"))))
    word = F.regexp_extract("text", r"[0-9]\s{0,2}(?i:(thousand|million|billion|trillion|lakh|crore))(?![\p{L}\p{N}])", 1)
    return rows.select("o_orderkey", number.alias("value"), F.when(word != "", number * power[F.lower(word)]).otherwise(F.lit(-1).cast("long")).alias("scaled"))


@query()
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.chunks import char_windows

    return char_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 4000, 200)


@query("""
WITH w AS (SELECT doc_id, n_chars, unnest(generate_series(0, greatest(0, (length(text) - 1) // 900))) * 900 AS s, length(text) AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, s AS "start", least(n, s + 1000) AS "end" FROM w
""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.chunks import fixed_windows as cut

    return cut(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 1000, 100).select("doc_id", "start", "end")
