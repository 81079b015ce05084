"""Queries of review tasks, answer checks, label samples and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, measure, review
from .registry import query, table


def _kind() -> Column:
    n = F.col("doc_id") % 4
    return review.item_kind(F.when(n == 0, "number").when(n == 1, "integer").otherwise("string"), n == 2, F.col("n_chars") > 1000)


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'number' WHEN doc_id % 4 = 2 THEN 'closed_set' WHEN n_chars > 1000 THEN 'span' ELSE 'text' END AS item FROM documents")
def item_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _kind().alias("item"))


@query("""
WITH t AS (SELECT doc_id AS task, CASE WHEN doc_id % 4 < 2 THEN 'number' WHEN doc_id % 4 = 2 THEN 'closed_set' WHEN n_chars > 1000 THEN 'span' ELSE 'text' END AS item, n_chars % 3 AS last FROM documents),
a AS (SELECT user_id AS reviewer, event_id AS sequence, CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id % 200 END AS task,
  CASE event_type WHEN 'view' THEN 'choose' WHEN 'click' THEN 'unsure' WHEN 'signup' THEN 'wrong' WHEN 'purchase' THEN 'correct' ELSE 'not_in_document' END AS verdict,
  CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) % 3 END AS decision,
  CASE WHEN event_type = 'purchase' AND value >= 2 THEN 'c' END AS candidate FROM events),
f AS (SELECT a.*, CASE WHEN t.task IS NULL THEN 'task' WHEN t.item = 'closed_set' AND verdict IN ('wrong', 'correct') THEN 'closed_set'
  WHEN verdict = 'choose' AND decision > t.last THEN 'decision' WHEN verdict = 'correct' AND candidate IS NULL THEN 'candidate' END AS fault
  FROM a LEFT JOIN t ON a.task = t.task)
SELECT reviewer, sequence, fault, coalesce(sequence < min(CASE WHEN fault IS NOT NULL THEN sequence END) OVER (PARTITION BY reviewer), TRUE) AS counts FROM f
""")
def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every user, checked against tasks; a log counts up to its first fault."""
    tasks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task"), _kind().alias("item"), F.sequence(F.lit(0), (F.col("n_chars") % 3).cast("int")).alias("choices"))
    kind = F.col("event_type")
    verdict = F.when(kind == "view", "choose").when(kind == "click", "unsure").when(kind == "signup", "wrong").when(kind == "purchase", "correct").otherwise("not_in_document")
    answers = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("reviewer"), F.col("event_id").alias("sequence"), F.when(F.col("event_id") % 97 == 0, F.lit(-1)).otherwise(F.col("event_id") % 200).alias("task"), verdict.alias("verdict"),
        F.when(kind == "view", F.floor("value") % 3).cast("int").alias("decision"), F.when((kind == "purchase") & (F.col("value") >= 2), "c").alias("candidate"), F.lit(1).alias("keys"), F.lit(5).alias("ms"),
    )
    return review.check_answers(answers, tasks).select("reviewer", "sequence", "fault", "counts")


@query("""
SELECT doc_id AS task, source AS field, CASE WHEN n_chars % 3 = 0 THEN 'audit' ELSE 'review' END AS mode,
  CASE WHEN n_chars % 3 > 0 THEN '0:' || coalesce(lang, '') || ',1:' || CAST(n_chars AS VARCHAR) END AS shown
FROM documents WHERE NOT (n_chars % 3 = 0 AND doc_id % 4 = 2)
""")
def blind_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks as a reviewer sees them: choices by number, none in an audit."""
    pick = lambda n, v: F.struct(F.lit(n).alias("decision"), v.alias("value"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("task"), F.when(F.col("n_chars") % 3 == 0, "audit").otherwise("review").alias("mode"), _kind().alias("item"), F.col("source").alias("field"),
        F.array(pick(7, F.coalesce("lang", F.lit(""))), pick(9, F.col("n_chars").cast("string"))).alias("choices"),
    )
    shown = F.array_join(F.transform("choices", lambda c: F.concat(c["choice"].cast("string"), F.lit(":"), c["value"])), ",")
    return review.blind(rows).select("task", "field", "mode", shown.alias("shown"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    codes = F.when(kind == "error", F.array(F.lit("KEY_NOT_AT_VALUE"))).when(kind == "signup", F.array(F.lit("QUALIFIED_VALUE"), F.lit("KEY_NOT_AT_VALUE"))).otherwise(F.array().cast("array<string>"))
    outcome = F.when(kind.isin("error", "signup"), "needs_verification").when(kind == "view", "rejected").otherwise("admitted")
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"), codes.alias("codes"), F.when(F.col("value") >= 1, F.lit(0)).alias("start"))


@query("""
SELECT event_id, 'key' AS question FROM events WHERE event_type IN ('error', 'signup') AND value >= 1
UNION ALL SELECT event_id, 'field' FROM events WHERE event_type IN ('error', 'click', 'purchase') AND value >= 1
""")
def label_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions to label for both questions; the field question with those that a judgment can clear."""
    rows = _decided(spark, sf_dir)
    key, own = calibration.label_sample(rows, "key"), calibration.label_sample(rows, "field", key_clear=True)
    return key.select("event_id", F.lit("key").alias("question")).unionByName(own.select("event_id", F.lit("field").alias("question")))


@query("""
SELECT doc_id, substr(text, greatest(a - 400, 0) + 1, a - greatest(a - 400, 0)) || '[' || substr(text, a + 1, 5) || ']' || substr(text, a + 6, 150) AS state
FROM (SELECT doc_id, text, length(text) // 2 AS a FROM documents)
""")
def prompt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window around five letters in the middle of each text."""
    middle = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", calibration.prompt_state(F.col("text"), middle, middle + 5).alias("state"))


@query("""
WITH g AS (SELECT DISTINCT doc_id, quality AS value FROM labels),
m AS (SELECT doc_id, n_chars % 2 AS value, CASE n_chars % 3 WHEN 0 THEN 'admitted' WHEN 1 THEN 'needs_verification' ELSE 'rejected' END AS outcome FROM documents)
SELECT count(*) AS facts, count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.value = g.value AND outcome = 'admitted')) AS accepted,
  count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.value = g.value AND outcome <> 'rejected')) AS accepted_or_review FROM g
""")
def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled facts that decisions state."""
    n = F.col("n_chars") % 3
    made = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("value"), F.when(n == 0, "admitted").when(n == 1, "needs_verification").otherwise("rejected").alias("outcome"))
    return measure.recall(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value")), made, ["doc_id", "value"])
