"""Queries of the cross-candidate operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets, spans
from .registry import query, table

PROPOSERS = ("signup", "error", "click", "view", "purchase")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (SELECT count(DISTINCT x.l_suppkey) > 1 FROM lineitem x WHERE x.l_partkey = l.l_partkey) AS conflict
FROM lineitem l
""")
def conflicting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sets.conflicts(rows, ["l_partkey"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "conflict")


@query("""
SELECT 'lines' AS field, o_orderkey AS id, 'REQUIRED_FIELD_MISSING' AS code FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT 'orders', c_custkey, 'REQUIRED_FIELD_MISSING' FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def required_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    no_lines = sets.missing_required(orders.select(F.lit("lines").alias("field"), F.col("o_orderkey").alias("id")), lines, ["id"])
    customers = table(spark, sf_dir, "customer").select(F.lit("orders").alias("field"), F.col("c_custkey").alias("id"))
    no_orders = sets.missing_required(customers, orders.select(F.col("o_custkey").alias("id")), ["id"])
    cols = ["field", "id", "code"]
    return no_lines.select(*cols).unionByName(no_orders.select(*cols))


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in microseconds: value minutes from ts; proposer is the event's type, key its user."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", start.alias("s"), (start + F.floor(F.col("value") * 60_000_000).cast("long")).alias("e"))


_SPANS = """
WITH x AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events)
"""


@query(_SPANS + """
SELECT a.event_id, EXISTS (SELECT 1 FROM x b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type
  AND b.s < b.e AND a.s < a.e AND b.s < a.e AND a.s < b.e) AS agrees FROM x a
""")
def agreement_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sets.overlaps(_event_spans(spark, sf_dir), ["user_id"], "event_type", "s", "e", PROPOSERS, "event_id")
    return out.select("event_id", "agrees")


@query(_SPANS + """
SELECT a.event_id, EXISTS (SELECT 1 FROM x b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type
  AND b.s < b.e AND a.s < a.e AND NOT (b.s < a.e AND a.s < b.e)) AS elsewhere FROM x a
""")
def other_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sets.overlaps(_event_spans(spark, sf_dir), ["user_id"], "event_type", "s", "e", PROPOSERS, "event_id")
    return out.select("event_id", "elsewhere")


@query("""
WITH p AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,4)) - s AS DECIMAL(28,6)) AS VARCHAR) AS difference,
       CAST(CAST(CAST(100000 AS DECIMAL(18,4)) + CAST('0.005' AS DECIMAL(28,6)) * (n + 1) AS DECIMAL(28,6)) AS VARCHAR) AS allowance,
       abs(CAST(o_totalprice AS DECIMAL(18,4)) - s) <= CAST(100000 AS DECIMAL(18,4)) + CAST('0.005' AS DECIMAL(28,6)) * (n + 1) AS holds
FROM orders JOIN p ON o_orderkey = k
""")
def relation_total_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    out = sets.relation_check(totals, parts, ["o_orderkey"], "o_totalprice", "l_extendedprice", tolerance="100000")
    return out.select("o_orderkey", F.col("difference").cast("string").alias("difference"), F.col("allowance").cast("string").alias("allowance"), "holds")


@query("""
WITH m AS (
  SELECT l_orderkey, min(l_returnflag) AS f1, max(l_returnflag) AS f2, min(l_linestatus) AS s1, max(l_linestatus) AS s2
  FROM lineitem GROUP BY 1)
SELECT l_orderkey, f1 AS returnflag, s1 AS linestatus,
       f1 <> f2 OR s1 <> s2 AS conflict,
       CASE WHEN f1 <> f2 OR s1 <> s2 THEN 'needs_verification' ELSE 'admitted' END AS outcome
FROM m
""")
def record_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    members = li.select("l_orderkey", F.inline(F.array(F.struct(F.lit("returnflag").alias("field"), F.col("l_returnflag").alias("value")), F.struct(F.lit("linestatus").alias("field"), F.col("l_linestatus").alias("value")))))
    out = sets.records(members, ["l_orderkey"], "field", "value", ["returnflag", "linestatus"], ["returnflag"])
    return out.select("l_orderkey", "returnflag", "linestatus", F.array_contains("codes", "MEMBER_CONFLICT").alias("conflict"), "outcome")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS replaced FROM lineitem
""")
def set_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sets.set_replace(rows, ["l_orderkey", "l_suppkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "replaced")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def set_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.set_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("""
SELECT l_partkey, count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_linestatus) = 1 AS holds
FROM lineitem GROUP BY 1 HAVING min(l_linenumber) < max(l_linenumber)
""")
def set_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.set_agree(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_linenumber", ["l_returnflag", "l_linestatus"])


@query("""
SELECT r_name, n_name, count(*) AS customers, CAST(sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
FROM (SELECT c_custkey, c_nationkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o FROM customer)
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name)
""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("live", F.lit(True))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(live, "c_custkey", "left")
    named = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.when(F.col("live").isNull(), 1).otherwise(0)).alias("missing"))


@query("""
SELECT l_orderkey AS k, 'left' AS side, count(*) AS n FROM
 (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1
UNION ALL
SELECT l_orderkey, 'right', count(*) FROM
 (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1
""")
def verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_suppkey"]
    diff = sets.verify_diff(li.filter("l_returnflag = 'A'").select(*cols), li.filter("l_linestatus = 'F'").select(*cols))
    return diff.groupBy(F.col("l_orderkey").alias("k"), "side").agg(F.count("*").alias("n"))


@query("""
SELECT e.event_id FROM events e WHERE EXISTS (
  SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'error' AND d.event_id <> e.event_id
    AND d.event_id * 10 < e.event_id * 10 + CAST(floor(e.value) AS BIGINT) AND e.event_id * 10 < d.event_id * 10 + CAST(floor(d.value) AS BIGINT)
    AND floor(e.value) > 0 AND floor(d.value) > 0) AND e.event_type <> 'error'
""")
def doubt_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") * 10).alias("s"), (F.col("event_id") * 10 + F.floor("value").cast("long")).alias("e"))
    marks = e.filter("event_type = 'error'").select("user_id", F.col("s").alias("ms"), F.col("e").alias("me"))
    return spans.overlap_semi(e.filter("event_type <> 'error'"), marks, ["user_id"], "s", "e", "ms", "me", width=256).select("event_id")


@query("""
WITH w AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + 8 AS e, l_linenumber // 3 AS page,
             CAST(l_quantity AS INTEGER) AS x0, CAST(l_linenumber AS INTEGER) AS y0, CAST(l_quantity AS INTEGER) + 5 AS x1, CAST(l_linenumber AS INTEGER) + 1 AS y1 FROM lineitem),
p AS (SELECT o_orderkey AS k, o_orderkey % 40 AS s, o_orderkey % 40 + 25 AS e FROM orders),
h AS (SELECT p.k, w.page, w.x0, w.y0, w.x1, w.y1, min(w.page) OVER (PARTITION BY p.k) AS first FROM p JOIN w ON p.k = w.k AND p.s < w.e AND w.s < p.e)
SELECT k, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h WHERE page = first GROUP BY k, page
""")
def locator_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (n * 10).alias("ws"), (n * 10 + 8).alias("we"), F.floor(n / 3).cast("int").alias("page"), q.alias("a"), n.alias("b"), (q + 5).alias("c"), (n + 1).alias("d"))
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 40).alias("s"), (F.col("o_orderkey") % 40 + 25).alias("e"))
    return spans.locators(at, words, ["k"], ["k"], "s", "e", "ws", "we", "page", ["a", "b", "c", "d"])


@query("""
WITH r AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS v FROM lineitem)
SELECT a.l_partkey, a.id AS a, b.id AS b FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.id < b.id AND abs(a.v - b.v) <= 500
""")
def near_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("v"))
    return spans.band_pairs(rows, ["l_partkey"], "id", "v", 500.0).select("l_partkey", "a", "b")


@query("""
WITH n AS (SELECT DISTINCT p_name AS x FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
SELECT a.x AS inner_name, b.x AS outer_name FROM n a JOIN n b ON a.x <> b.x AND contains(' ' || b.x || ' ', ' ' || a.x || ' ')
""")
def schema_lint_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name")
    names = p.unionByName(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("p_name")))
    return spans.contained_names(names, "p_name").select(F.col("inner").alias("inner_name"), F.col("outer").alias("outer_name"))
