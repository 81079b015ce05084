"""Queries of calibration, audit and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, review
from ..operators.windows import latest
from .registry import query, table

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)


def _key(name: str = "doc_id"):
    return F.col(name).cast("string")


@query("""
SELECT doc_id FROM documents
WHERE CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT)::HUGEINT * 100 < 10 * 18446744073709551616::HUGEINT
""")
def audit_pick_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").filter(calibration.picked_at(_key(), "0.10"))


@query()
def audit_pick_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor("value").cast("long").alias("items"), F.when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), F.lit("0.02")).alias("rate"))
    return calibration.audit_pick(e, "event_type", "event_id", "event_id", "items", "seed", "rate")


@query("""
SELECT doc_id, CASE WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) <= '7' THEN 'calibration' ELSE 'test' END AS part FROM documents
""")
def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", calibration.calibration_half(_key()).alias("part"))


@query()
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return calibration.clopper_pearson(counts, "k", "n")


@query("""
WITH c AS (SELECT quality, CAST(sum(toxic) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY 1)
SELECT quality, round((k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)))/(1 + 1.96*1.96/n), 9) AS low,
       round((k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)))/(1 + 1.96*1.96/n), 9) AS high FROM c
""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    low, high = calibration.wilson(F.col("k"), F.col("n"))
    return counts.select("quality", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_ANSWERS = "WITH a AS (SELECT value / 500 AS p, event_type <> 'error' AS ok FROM events), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("value") / 500).alias("p"), (F.col("event_type") != "error").alias("ok"))


@query(_ANSWERS + """
SELECT threshold, count(*) FILTER (p >= threshold) AS cleared, count(*) FILTER (p >= threshold AND NOT ok) AS escapes FROM t, a GROUP BY 1
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.threshold_sweep(_answers(spark, sf_dir), "p", "ok", THRESHOLDS)


@query(_ANSWERS + """
SELECT min(threshold) AS threshold FROM (
  SELECT threshold, count(*) FILTER (p >= threshold) AS c, count(*) FILTER (p >= threshold AND NOT ok) AS e FROM t, a GROUP BY 1) WHERE c > 0 AND e < 0.2 * c
""")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = calibration.threshold_sweep(_answers(spark, sf_dir), "p", "ok", THRESHOLDS)
    return calibration.operating_point(sweep, (F.col("cleared") > 0) & (F.col("escapes") < 0.2 * F.col("cleared")))


@query("""
WITH d AS (SELECT doc_id, lang, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS value FROM documents)
SELECT coalesce(d.lang, '-') AS route,
       count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS scored,
       count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL AND quality IS NOT DISTINCT FROM value) AS "right",
       count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL AND quality IS DISTINCT FROM value) AS wrong,
       count(*) FILTER (d.doc_id IS NULL) AS missed, count(*) FILTER (l.doc_id IS NULL) AS unscored
FROM labels l FULL OUTER JOIN d ON l.doc_id = d.doc_id GROUP BY 1
""")
def route_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label against every document: missed are labels that have no document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("value"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = calibration.route_score(labels, docs, ["doc_id"], ["lang"], "quality", "value")
    return out.withColumn("route", F.coalesce("lang", F.lit("-"))).drop("lang")


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (value < 10) AS wrong, ceil(100.0 * count(*) FILTER (value < 10) / count(*)) / 100.0 AS share FROM events GROUP BY 1
""")
def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.event_shares(table(spark, sf_dir, "events"), ["event_type"], F.col("value") < 10)


@query("""
WITH latest AS (SELECT conv_id, role, length(text) % 3 AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1)
SELECT conv_id, CASE WHEN count(DISTINCT target) > 1 THEN 'disputed' WHEN count(*) >= 2 THEN 'agreed' ELSE 'open' END AS status FROM latest GROUP BY 1
""")
def agreed_or_disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("text"))
    return review.settle(answers, "conv_id", "role", ["turn", "text"], F.length("text") % 3, agree=2)


@query("""
WITH r AS (SELECT conv_id AS slot, role, length(text) % 3 AS answer FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1)
SELECT a.slot, a.role AS first, b.role AS second, a.answer = b.answer AS same FROM r a JOIN r b ON a.slot = b.slot AND a.role < b.role
""")
def blind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the reviewers (roles) of each slot (conversation), by their latest answers, over the whole table."""
    answers = latest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn", "text"])
    rows = answers.select(F.col("conv_id").alias("slot"), "role", (F.length("text") % 3).alias("answer"))
    return review.reviewer_pairs(rows, ["slot"], "role", "answer")


@query("""
WITH t AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'), a AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND turn >= 3)
SELECT conv_id FROM t WHERE conv_id NOT IN (SELECT conv_id FROM a)
""")
def open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tasks = c.filter("role = 'user'").select("conv_id").distinct()
    return review.open_tasks(tasks, c.filter("role = 'assistant' AND turn >= 3").select("conv_id"), ["conv_id"])


@query("""
SELECT c_nationkey, c_mktsegment, c_custkey FROM customer
WHERE (c_nationkey, c_mktsegment, c_custkey) > (7, 'BUILDING', 0) ORDER BY 1, 2, 3 LIMIT 50
""")
def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a list: the 50 rows after a key."""
    return review.page(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment", "c_custkey"], (7, "BUILDING", 0), 50)
