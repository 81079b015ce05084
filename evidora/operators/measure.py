"""Measurement of a profile on labelled documents: scores of each field at each threshold, bounds, operating points, pooled routes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import calibration_half, clopper_pearson


def scores(rows: DataFrame, labels: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(part, field, threshold, cleared, escapes, missed, n): one pass over decisions and labels for all thresholds.

    rows: decisions with `p`, the probability of a recorded judgment of the candidate's key, null without one.
    labels: (doc_id, field, key, value), value null where the document states none. A value counts as admitted at a
    threshold if it is admitted as it is, or if KEY_NOT_AT_VALUE is its only flag and p reaches the threshold: a
    threshold moves no other flag, so the gate need not run again for each.
    """
    plain = F.col("outcome") == "admitted"
    cleared = (F.col("outcome") == "needs_verification") & (F.size(F.array_except("codes", F.array(F.lit("KEY_NOT_AT_VALUE")))) == 0)
    level = F.when(plain, F.lit(0.0)).when(cleared, F.col("p"))
    made = rows.filter(level.isNotNull()).select("doc_id", "field", F.coalesce("key", F.lit("")).alias("_k"), F.col("value").alias("_made"), level.alias("_level"))
    # one value at its lowest level for each slot and value
    made = made.groupBy("doc_id", "field", "_k", "_made").agg(F.min("_level").alias("_level"))
    truth = labels.select("doc_id", "field", F.coalesce("key", F.lit("")).alias("_k"), F.col("value").alias("_true"), F.lit(True).alias("_has"))
    both = truth.join(made, ["doc_id", "field", "_k"], "left")
    both = both.withColumn("part", calibration_half(F.col("doc_id")))
    at = both.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    live = F.coalesce(F.col("_level") <= F.when(F.col("_level") == 0, F.lit(0.0)).otherwise(1.0), F.lit(False)) & ((F.col("_level") == 0) | (F.col("_level") >= F.col("threshold")))
    right = live & F.col("_made").eqNullSafe(F.col("_true"))
    count = lambda c: F.sum(c.cast("long"))
    return at.groupBy("part", "field", "threshold").agg(
        count(live).alias("cleared"), count(live & ~right).alias("escapes"), count(F.col("_true").isNotNull() & ~right).alias("missed"), F.count("*").alias("n"),
    )


def pooled(scored: DataFrame) -> DataFrame:
    """Scores of each field and of all fields together (field null), by rollup."""
    out = scored.rollup("part", "threshold", "field").agg(*(F.sum(c).alias(c) for c in ("cleared", "escapes", "missed", "n")))
    return out.filter(F.col("part").isNotNull() & F.col("threshold").isNotNull())


def operating_points(scored: DataFrame, target: float) -> DataFrame:
    """(field, threshold, bound, status): the lowest threshold whose bound on calibration documents is below the target, and its bound on test documents.

    status: measured if the bound on test documents holds the target too, else draft.
    """
    bounded = clopper_pearson(scored, "escapes", "cleared")
    chosen = bounded.filter((F.col("part") == "calibration") & (F.col("bound") < target)).groupBy("field").agg(F.min("threshold").alias("threshold"))
    tests = bounded.filter(F.col("part") == "test").select("field", "threshold", "bound")
    out = scored.select("field").distinct().join(chosen, "field", "left").join(tests, ["field", "threshold"], "left")
    return out.withColumn("status", F.when(F.col("bound") < target, "measured").otherwise("draft"))


def draft_profile(profile: dict[str, Any], points: DataFrame, date: str) -> dict[str, Any]:
    """A profile with the routes that were measured; as many rows as it has fields."""
    routes = [{"field": r["field"], "route": "key", "status": r["status"], "date": date, "bound": None if r["bound"] is None else f"{r['bound']:.4f}".rstrip("0").rstrip(".")} for r in points.orderBy("field").collect()]
    lowest = [r["threshold"] for r in points.collect() if r["threshold"] is not None]
    judge = dict(profile.get("policy", {}).get("judge") or {})
    if judge and lowest:
        judge["clear"] = {"KEY_NOT_AT_VALUE": max(lowest)}
    return {**profile, "policy": {**profile.get("policy", {}), **({"judge": judge} if judge else {})}, "routes": routes}


def planted_table(rows: DataFrame, planted: str) -> DataFrame:
    """Shares of each outcome for each class of planted error."""
    by = rows.groupBy(planted).pivot("outcome", ["admitted", "needs_verification", "rejected"]).agg(F.count("outcome")).na.fill(0)
    n = F.col("admitted") + F.col("needs_verification") + F.col("rejected")
    return by.select(planted, n.alias("n"), *(F.round(F.col(c) / n, 4).alias(c) for c in ("admitted", "needs_verification", "rejected")))


def recall(gold: DataFrame, made: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(facts, accepted, accepted_or_review): distinct gold facts, those that an admitted decision states, and those that one not rejected does.

    Decisions fall to one row a fact before the join, so that a fact stated many times is one row.
    """
    found = made.filter(F.col("outcome").isin("admitted", "needs_verification")).groupBy(*keys).agg(F.max((F.col("outcome") == "admitted").cast("int")).alias("_a"))
    facts = gold.select(*keys).distinct().alias("g")
    both = facts.join(found.alias("m"), [F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(F.count("*").alias("facts"), total(F.coalesce(F.col("_a"), F.lit(0))).alias("accepted"), total(F.col("_a").isNotNull()).alias("accepted_or_review"))
