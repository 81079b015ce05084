"""Further queries: text functions, set operations, review, measurement and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calibration, extract, gate, measure, resolution, review, sets, windows
from ..session import ship
from .gate_queries import _PLANTED, SCHEMA, _admitted
from ..tables import deal, shuffle_tasks, spread
from .registry import query, table

# ---------------------------------------------------------------- text functions


@query("SELECT o_orderkey, rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '0'), '.') AS value FROM orders")
def canonical_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.canonical_decimal(F.col("o_totalprice").cast("decimal(18,4)").cast("string")).alias("value"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN o_custkey || ',0' WHEN 2 THEN CAST(o_custkey AS VARCHAR)
  ELSE '1,' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') END AS token FROM orders)
SELECT o_orderkey, token, regexp_full_match(token, '[0-9]+|[0-9]{1,3}(,[0-9]{3})+|[0-9]{1,2}(,[0-9]{2})*,[0-9]{3}') AS has_value FROM t
""")
def grouping_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    token = F.when(k % 4 == 0, F.concat(c.cast("string"), F.lit(","), pad(k % 1000, 3))).when(k % 4 == 1, F.concat(c.cast("string"), F.lit(",0"))).when(k % 4 == 2, c.cast("string")).otherwise(F.concat(F.lit("1,"), pad(k % 100, 2), F.lit(","), pad(c % 1000, 3)))
    return table(spark, sf_dir, "orders").select("o_orderkey", token.alias("token")).withColumn("has_value", C.has_value(F.col("token")))


@query("SELECT doc_id, lower(translate(text, 'ſıİ' || chr(8490), 'siik')) AS folded FROM documents")
def letter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document folded, those with look-alike letters and without text too."""
    return table(spark, sf_dir, "documents").select("doc_id", C.fold(F.col("text")).alias("folded"))


@query("""
SELECT doc_id, CAST(strlen(substr(text, 1, length(text) // 3)) AS INTEGER) AS third, CAST(strlen(substr(text, 1, length(text) * 2 // 3)) AS INTEGER) AS two_thirds,
  CAST(strlen(substr(text, 1, length(text))) AS INTEGER) AS whole FROM documents
""")
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets over the whole text: each third and the end."""
    n = F.length("text")
    at = lambda k: C.byte_offset(F.col("text"), F.floor(n * k / 3).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", at(1).alias("third"), at(2).alias("two_thirds"), at(3).alias("whole"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', '?', 'g') AS shown FROM documents")
def control_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.visible(F.col("text")).alias("shown"))


@query("SELECT event_id, rtrim(rtrim(printf('%.4f', value / 500), '0'), '.') AS rate FROM events")
def rate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.rate(F.col("value") / 500).alias("rate"))


@query("""
SELECT doc_id, CASE WHEN length(trim(text)) = 0 OR text IS NULL THEN 'no_text' WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'complete' END AS status FROM documents
""")
def completeness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import completeness

    missing = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "documents").select("doc_id", completeness(F.col("text"), missing).alias("status"))


# ---------------------------------------------------------------- sets


@query("""
SELECT 'missing' AS problem, doc_id AS key FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orphan', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (labels) without an object, and objects (documents) without a name."""
    have = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    named = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")).distinct()
    return sets.strays(named, have, ["key"])


@query("SELECT e.event_id, c.c_name IS NULL AS missing FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 20")
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the text that they name, those without it marked."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 20).alias("c_custkey"))
    return e.join(names, "c_custkey", "left").select("event_id", F.col("c_name").isNull().alias("missing"))


@query("SELECT user_id, count(DISTINCT (event_type, CAST(floor(value) AS BIGINT))) AS items FROM events WHERE event_type <> 'error' GROUP BY 1")
def admitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return e.groupBy("user_id").agg(F.count_distinct(F.struct("event_type", F.floor("value"))).alias("items"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(['small', 'red', 'blue', 'ring'], lambda w: contains(p_name, w))), ',') AS marks FROM part")
def pack_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of a list occur in each text."""
    words = F.array(*(F.lit(w) for w in ("small", "red", "blue", "ring")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.filter(words, lambda w: F.contains(F.col("p_name"), w))), ",").alias("marks"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_type NOT IN ('ECONOMY', 'SMALL'))), ',') AS added FROM part GROUP BY 1")
def added_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each pack that the base list does not have."""
    words = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("w"))
    return words.select("p_brand", F.array_join(F.array_sort(F.array_except("w", F.array(F.lit("ECONOMY"), F.lit("SMALL")))), ",").alias("added"))


@query("""
WITH v AS (SELECT l_partkey AS k, CAST(round(l_extendedprice) AS BIGINT) AS v, 1 AS place FROM lineitem WHERE l_linenumber <> 1
  UNION ALL SELECT l_partkey, CAST(round(l_extendedprice / 1000) AS BIGINT) * 1000, 1000 FROM lineitem WHERE l_linenumber = 1)
SELECT k, v, count(*) AS n FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.k = a.k AND b.place < a.place AND b.v <> a.v AND abs(a.v - b.v) <= a.place / 2) GROUP BY 1, 2
""")
def drop_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fine = li.filter("l_linenumber <> 1").select(F.col("l_partkey").alias("k"), F.round("l_extendedprice").cast("decimal(18,0)").alias("v"), F.lit(1).cast("decimal(18,0)").alias("place"))
    rough = li.filter("l_linenumber = 1").select(F.col("l_partkey").alias("k"), (F.round(F.col("l_extendedprice") / 1000) * 1000).cast("decimal(18,0)").alias("v"), F.lit(1000).cast("decimal(18,0)").alias("place"))
    out = extract.without_rounded(fine.unionByName(rough), ["k"], "v", "place")
    return spread(out, shuffle_tasks(li), "k", "v").groupBy("k", "v").agg(F.count("*").alias("n")).withColumn("v", F.col("v").cast("long"))


# ---------------------------------------------------------------- review


@query(_PLANTED + """
SELECT field, CASE outcome WHEN 'admitted' THEN 'audit' WHEN 'rejected' THEN 'rejected' ELSE 'review' END AS mode, count(*) AS n FROM d GROUP BY 1, 2
""")
def review_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = resolution.slots_of(_admitted(spark, sf_dir)[1], [])
    return slots.groupBy("field", "mode").agg(F.count("*").alias("n"))


@query(_PLANTED + """
SELECT 'review' AS mode, count(*) AS n FROM d WHERE outcome = 'needs_verification'
UNION ALL SELECT 'missing', count(*) FROM d WHERE field = 'total' AND outcome = 'rejected'
""")
def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, rows = _admitted(spark, sf_dir)
    tasks = resolution.tasks_of(resolution.slots_of(rows, []), gate.coverage(p, rows, SCHEMA), audit_rate="0")
    return tasks.groupBy("mode").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT conv_id AS task, CASE conv_id % 3 WHEN 0 THEN 'audit' ELSE 'review' END AS mode FROM (SELECT DISTINCT conv_id FROM conversations)),
l AS (SELECT conv_id AS task, role, CASE WHEN length(text) % 5 = 0 THEN 'unsure' WHEN length(text) % 5 = 1 THEN 'confirm' ELSE 'choose' END AS verdict, CASE WHEN length(text) % 5 > 1 THEN length(text) % 2 END AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1),
s AS (SELECT task, count(*) AS n, count(DISTINCT (verdict, coalesce(target, -1))) AS kinds, min(verdict) AS verdict FROM l WHERE verdict <> 'unsure' GROUP BY 1)
SELECT t.task, CASE WHEN mode = 'audit' AND (n IS NULL OR (kinds = 1 AND verdict = 'confirm')) THEN 'admitted' WHEN n IS NULL THEN 'open' WHEN kinds > 1 THEN 'disputed' WHEN verdict = 'confirm' THEN 'confirmed' ELSE 'chosen' END AS status
FROM t LEFT JOIN s ON s.task = t.task
""")
def resolved_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tasks = c.select(F.col("conv_id").alias("task")).distinct().withColumn("mode", F.when(F.col("task") % 3 == 0, "audit").otherwise("review")).withColumn("value", F.lit("0"))
    n = F.length("text")
    answers = c.select(F.col("conv_id").alias("task"), F.col("role").alias("reviewer"), F.col("turn").alias("sequence"), F.when(n % 5 == 0, "unsure").when(n % 5 == 1, "confirm").otherwise("choose").alias("verdict"), F.when(n % 5 > 1, (n % 2).cast("string")).alias("target"))
    return resolution.resolve(tasks, answers).select("task", "status")


@query("""
SELECT count(*) AS audited, CAST(sum(CASE WHEN s.quality IS DISTINCT FROM m.toxic THEN 1 ELSE 0 END) AS BIGINT) AS escapes FROM labels s JOIN labels m ON m.doc_id = s.doc_id
""")
def audit_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label is audited."""
    s = table(spark, sf_dir, "labels")
    return review.escapes(s.select("doc_id", F.col("quality").alias("settled")), s.select("doc_id", F.col("toxic").alias("made")), ["doc_id"], "settled", "made")


@query("SELECT role AS item, count(*) AS answers, count(DISTINCT conv_id % 7) AS reviewers, count(*) FILTER (length(text) % 9 = 0) AS unsure, quantile_cont(length(text), 0.5) AS median_ms FROM conversations GROUP BY 1")
def review_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    answers = table(spark, sf_dir, "conversations").select(F.col("role").alias("item"), (F.col("conv_id") % 7).alias("reviewer"), F.when(n % 9 == 0, "unsure").otherwise("confirm").alias("verdict"), n.alias("ms"))
    return resolution.review_measures(answers)


# ---------------------------------------------------------------- measurement


@query(_PLANTED + """
SELECT CAST(planted AS INTEGER) AS planted, count(*) AS n, round(avg(CAST(outcome = 'admitted' AS INTEGER)), 4) AS admitted,
  round(avg(CAST(outcome = 'needs_verification' AS INTEGER)), 4) AS needs_verification, round(avg(CAST(outcome = 'rejected' AS INTEGER)), 4) AS rejected
FROM d WHERE field = 'total' GROUP BY 1
""")
def planted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _admitted(spark, sf_dir)[1].filter("field = 'total'")
    return measure.planted_table(rows.withColumn("planted", (F.col("doc_id").cast("long") % 8).cast("int")), "planted")


@query("""
SELECT CASE WHEN event_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS part, t AS threshold, coalesce(event_type, '') AS field, count(*) FILTER (value / 500 >= t) AS cleared, count(*) AS n
FROM events, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.7 AS DOUBLE))) v(t) GROUP BY part, t, ROLLUP (event_type)
""")
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "calibration").otherwise("test").alias("part"), F.col("event_type").alias("field"), (F.col("value") / 500).alias("p"))
    at = e.withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(0.7))))
    scored = at.groupBy("part", "field", "threshold").agg(F.sum((F.col("p") >= F.col("threshold")).cast("long")).alias("cleared"), F.lit(0).cast("long").alias("escapes"), F.lit(0).cast("long").alias("missed"), F.count("*").alias("n"))
    # levels above (part, threshold) are of no use here
    out = measure.pooled(scored)
    return out.select("part", "threshold", F.coalesce("field", F.lit("")).alias("field"), "cleared", "n")


@query("SELECT source AS profile, CAST(sum(n_chars) AS BIGINT) AS covered, CASE WHEN bool_and(lang = 'en') AND sum(n_chars) >= 30 THEN '0.02' ELSE '0.1' END AS rate FROM documents GROUP BY 1")
def audit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("profile")).agg(F.sum("n_chars").alias("covered"), F.bool_and(F.col("lang") == "en").alias("all"))
    return d.select("profile", "covered", F.when(F.col("all") & (F.col("covered") >= 30), "0.02").otherwise("0.1").alias("rate"))


@query("SELECT d.doc_id, quality FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE CAST(('0x' || substr(sha256(CAST(d.doc_id AS VARCHAR)), 1, 16)) AS UBIGINT)::HUGEINT * 10 < 5 * 18446744073709551616::HUGEINT")
def labels_of_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each picked document."""
    picked = table(spark, sf_dir, "documents").select("doc_id").filter(calibration.picked_at(F.col("doc_id").cast("string"), "0.5"))
    last = windows.latest(table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])
    return last.join(picked, "doc_id", "left_semi")


# ---------------------------------------------------------------- structure


@query("SELECT o_orderkey AS doc_id, 'items' AS field, CAST(o_orderkey % 7 + 1 AS VARCHAR) AS value, 'admitted' AS outcome FROM orders")
def structure_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labelled lines propose, decided by the gate."""
    from .gate_queries import packets

    ship(spark)
    schema = {"fields": {"items": {"type": "integer", "aliases": ["Items"]}}}
    found = extract.structure_candidates(packets(spark, sf_dir, dealt=deal).select("doc_id", "text"), schema, keep_text=True)
    rows = gate.admit(found, schema)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "field", "value", "outcome")


@query("""
WITH n AS (SELECT l_orderkey AS k, l_linenumber AS id, l_linenumber AS s, l_linenumber + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT o_orderkey AS k, CAST(coalesce((SELECT max(s * 100 + id) % 100 FROM n WHERE n.k = o_orderkey AND n.s <= 5 AND 5 < n.e), -1) AS BIGINT) AS node FROM orders
""")
def innermost_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.markup import innermost

    n = F.col("l_linenumber").cast("long")
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("id"), n.alias("start"), (n + F.col("l_quantity").cast("long")).alias("end"))
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(5).cast("long").alias("at"))
    found = innermost(nodes, places, "k", "at")
    return places.join(found, ["k", "at"], "left").select("k", F.coalesce("node", F.lit(-1)).alias("node"))


@query("SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return calibration.first_of_text(docs, "text", ["doc_id"]).select("doc_id", "n_chars")


@query("""
SELECT doc_id, f AS field, k AS key FROM documents, (VALUES ('dose', 'adults'), ('dose', 'children'), ('name', NULL)) t(f, k)
WHERE CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT)::HUGEINT * 10 < 1 * 18446744073709551616::HUGEINT
""")
def audit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = table(spark, sf_dir, "documents").select("doc_id").filter(calibration.picked_at(F.col("doc_id").cast("string"), "0.1"))
    return calibration.audit_tasks(picked, {"dose": ["adults", "children"], "name": None})


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, 'the' AS value, min(line) AS line FROM l WHERE list_contains(regexp_split_to_array(line, '[^\\p{L}\\p{N}.,]+'), 'the') GROUP BY 1 HAVING count(*) = 1
""")
def value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which one line alone holds a word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return calibration.value_lines(docs, docs.select("doc_id", F.lit("the").alias("value")))


@query("""
SELECT 'cached' AS status, count(*) AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'to read', count(*) FROM pages WHERE page_id % 3 <> 0
""")
def reading_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.sha2("html", 256).alias("source"), F.lit("html/1").alias("reader"), "page_id")
    done = pages.filter("page_id % 3 = 0").select("page_id", "source", "reader", F.lit(True).alias("stored"))
    cached, rest = calibration.reading_cache(pages, done, ["page_id", "source", "reader"])
    count = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("status"), "n")
    return count(cached, "cached").unionByName(count(rest, "to read"))
