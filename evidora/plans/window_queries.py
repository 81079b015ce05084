"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from .registry import query, table


@query("""
SELECT conv_id, role, turn, md5(text) AS answer FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1
""")
def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    return windows.latest(rows, ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", F.md5(F.col("text").cast("binary")).alias("answer"))


@query("""
SELECT user_id, origin, event_id FROM (
  SELECT user_id, json_extract_string(props, '$.k') AS origin, event_id,
         row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id) AS k FROM events) WHERE k = 1
""")
def first_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("origin"), "event_id")
    return windows.first(rows, ["user_id", "origin"], ["event_id"]).select("user_id", "origin", "event_id")


@query("""
WITH l AS (
  SELECT user_id, event_id, row_number() OVER w AS n, sha256(CAST(event_id AS VARCHAR) || ':' || event_type) AS entry,
         CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE lag(sha256(CAST(event_id AS VARCHAR) || ':' || event_type)) OVER w END AS previous
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, previous IS NOT DISTINCT FROM lag(entry) OVER (PARTITION BY user_id ORDER BY event_id) AS linked FROM l
""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of each user, in which every 97th entry names another predecessor."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    entry = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), 256)
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("sequence"), entry.alias("entry"))
    log = log.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.lag("entry").over(w)))
    return windows.chain_check(log, ["user_id"], "sequence", "entry", "previous").select("user_id", "event_id", "linked")


@query("""
WITH x AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, island
""")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .set_queries import _event_spans

    return windows.merge_windows(_event_spans(spark, sf_dir).select("user_id", "s", "e"), ["user_id"], "s", "e")


@query("""
SELECT user_id, event_id, value, CAST(k AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 8
""")
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return windows.top_per_group(rows, ["user_id"], [F.desc("value"), F.asc("event_id")], 8)


@query("""
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS mark FROM events
""")
def nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return windows.nearest_before(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), "mark").select("event_id", "user_id", F.coalesce("mark", F.lit(-1)).alias("mark"))


@query("""
WITH h AS (SELECT user_id, event_id, event_id % 6 + 1 AS level FROM events)
SELECT user_id, event_id, coalesce((SELECT min(b.event_id) FROM h b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.level <= a.level), -1) AS section_end FROM h a
""")
def section_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 6 + 1).alias("level"))
    return windows.section_end(h, ["user_id"], "event_id", "level", 6).select("user_id", "event_id", F.coalesce("section_end", F.lit(-1)).alias("section_end"))


@query("""
SELECT event_type, quantile_cont(value, 0.5) AS median_ms, count(*) AS n FROM events GROUP BY 1
""")
def median_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median_ms"), F.count("*").alias("n"))


@query("""
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0.1) AS rate FROM events
""")
def rate_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return windows.in_force(rows, ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("value")), 0.1, "rate").select("event_id", "user_id", "rate")
