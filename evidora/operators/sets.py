"""Cross-candidate operators: conflicts, coverage, agreement, relations, records and set checks. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MONEY = "decimal(18,4)"


def conflicts(values: DataFrame, keys: Sequence[str], value: Sequence[str], flag: str = "conflict") -> DataFrame:
    """Mark rows whose keys have more than one distinct value.

    Only the least and the greatest value of each key are shuffled, so a hot key costs one row a task.
    """
    both = F.struct(*value)
    ends = values.groupBy(*keys).agg(F.min(both).alias("_least"), F.max(both).alias("_most"))
    split = ends.select(*keys, (~F.col("_least").eqNullSafe(F.col("_most"))).alias(flag))
    return values.join(split, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def missing_required(slots: DataFrame, live: DataFrame, keys: Sequence[str], code: str = "REQUIRED_FIELD_MISSING") -> DataFrame:
    """Required slots for which no live decision exists."""
    return slots.join(live.select(*keys).distinct(), list(keys), "left_anti").withColumn("code", F.lit(code))


def overlaps(spans: DataFrame, keys: Sequence[str], proposer: str, start: str, end: str, proposers: Sequence[str], tie: str) -> DataFrame:
    """Add `agrees` and `elsewhere`: whether another proposer's span of the same keys shares a point with the row's span, and whether one does not.

    A sweep in order of start, with the furthest end of each proposer so far: linear after the sort where a join of
    spans would be quadratic. proposers: the closed list that a policy names. Empty spans agree with nothing.
    """
    real = F.col(start) < F.col(end)
    by = W.partitionBy(*keys).orderBy(F.col(start), F.col(tie))
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)

    def other(pick, what: str, frame) -> Column:
        """Least or greatest over the proposers that are not the row's own."""
        each = [F.when(F.col(proposer) != p, pick(F.when(real & (F.col(proposer) == p), F.col(what))).over(frame)) for p in proposers]
        fold = F.greatest if pick is F.max else F.least
        return fold(*each)

    out = spans.withColumns({"_far": other(F.max, end, before), "_near": other(F.min, start, after), "_early": other(F.min, end, before), "_late": other(F.max, start, after)})
    agrees = real & F.coalesce((F.col("_far") > F.col(start)) | (F.col("_near") < F.col(end)), F.lit(False))
    # an earlier span ends before this one starts, or a later one starts after it ends
    apart = F.coalesce(F.col("_early") <= F.col(start), F.lit(False)) | F.coalesce(F.col("_late") >= F.col(end), F.lit(False))
    return out.withColumns({"agrees": agrees, "elsewhere": real & apart}).drop("_far", "_near", "_early", "_late")


def relation_check(totals: DataFrame, parts: DataFrame, keys: Sequence[str], total: str, part: str, factor: Column | None = None, tolerance: str = "0", place: str = "0.01") -> DataFrame:
    """Total minus the sum of factor * part against the tolerance plus half a place for each value. Exact decimals.

    Rows (keys, difference, allowance, holds) of keys that have a total and a part.
    """
    f = factor if factor is not None else F.lit(1).cast(MONEY)
    sums = parts.groupBy(*keys).agg(F.sum((f * F.col(part).cast(MONEY)).cast("decimal(28,6)")).alias("_sum"), F.sum((F.abs(f) * F.lit(place).cast(MONEY) / 2).cast("decimal(28,6)")).alias("_half"))
    joined = totals.join(sums, list(keys))
    difference = (F.col(total).cast(MONEY) - F.col("_sum")).cast("decimal(28,6)")
    allowance = (F.lit(tolerance).cast(MONEY) + F.lit(place).cast(MONEY) / 2 + F.col("_half")).cast("decimal(28,6)")
    return joined.select(*keys, difference.alias("difference"), allowance.alias("allowance"), (F.abs(difference) <= allowance).alias("holds"))


def records(decisions: DataFrame, keys: Sequence[str], field: str, value: str, members: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """One row a record: each member's value, the record's codes and outcome.

    A member with two values is a conflict, a required member without one is missing; a record with a code is not admitted.
    """
    agg = []
    for m in members:
        v = F.when(F.col(field) == m, F.col(value))
        agg += [F.min(v).alias(m), F.max(v).alias(f"_{m}")]
    out = decisions.groupBy(*keys).agg(*agg)
    conflict = F.lit(False)
    for m in members:
        conflict = conflict | F.coalesce(F.col(m) != F.col(f"_{m}"), F.lit(False))
    missing = F.lit(False)
    for m in required:
        missing = missing | F.col(m).isNull()
    codes = F.filter(F.array(F.when(missing, F.lit("MEMBER_MISSING")), F.when(conflict, F.lit("MEMBER_CONFLICT"))), lambda x: x.isNotNull())
    return out.withColumn("codes", codes).withColumn("outcome", F.when(F.size("codes") > 0, "needs_verification").otherwise("admitted")).drop(*(f"_{m}" for m in members))


def set_replace(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Mark rows that a row of the same keys at a later position replaces."""
    last = rows.groupBy(*keys).agg(F.max(position).alias("_last"))
    return rows.join(last, list(keys), "left").withColumn("replaced", F.coalesce(F.col(position) < F.col("_last"), F.lit(False))).drop("_last")


def set_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def set_agree(rows: DataFrame, keys: Sequence[str], position: str, compare: Sequence[str]) -> DataFrame:
    """(keys, holds): whether all compared members are the same at all positions; of keys at two positions or more."""
    agg = [F.min(position).alias("_first"), F.max(position).alias("_last")]
    for c in compare:
        agg += [F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"), F.count(c).alias(f"_n_{c}")]
    out = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *agg).filter(F.col("_first") < F.col("_last"))
    holds = F.lit(True)
    for c in compare:
        holds = holds & ((F.col(f"_n_{c}") == 0) | ((F.col(f"_a_{c}") == F.col(f"_b_{c}")) & (F.col(f"_n_{c}") == F.col("_n"))))
    return out.select(*keys, holds.alias("holds"))


def strays(named: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(problem, keys): names without an object (missing), and objects that nothing names (orphan)."""
    missing = named.join(have.select(*keys), list(keys), "left_anti").select(F.lit("missing").alias("problem"), *keys)
    return missing.unionByName(have.join(named.select(*keys), list(keys), "left_anti").select(F.lit("orphan").alias("problem"), *keys))


def verify_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has and the other lacks, with multiplicity; side says which."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
