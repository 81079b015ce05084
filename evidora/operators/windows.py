"""Operators over ordered rows: latest and first rows, chains, islands, as-of and section ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: an aggregate of structs, so that a hot key is merged before the shuffle."""
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; the mirror of latest()."""
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def chain_check(log: DataFrame, keys: Sequence[str], sequence: str, entry: str, previous: str) -> DataFrame:
    """Add `linked`: the row continues its log, by number and by the hash of the row before."""
    w = W.partitionBy(*keys).orderBy(sequence)
    number, before = F.row_number().over(w), F.lag(entry).over(w)
    return log.withColumn("linked", (F.col(sequence) == number) & F.col(previous).eqNullSafe(before))


def merge_windows(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of spans that overlap or touch, with how many spans each holds."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = spans.withColumn("_new", new).withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank. Spark cuts each task's groups to k rows before the shuffle (window group limit)."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def nearest_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marks: Column, value: Column, name: str) -> DataFrame:
    """Add the value of the last earlier row for which `marks` holds (as-of, backward)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(marks, value), ignorenulls=True).over(w))


def section_end(headings: DataFrame, keys: Sequence[str], order: str, level: str, levels: int, name: str = "section_end") -> DataFrame:
    """Add the order of the next heading of the same or a higher level (a lesser or equal number); null at the last."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    ends = F.array(*(F.min(F.when(F.col(level) <= n, F.col(order))).over(w) for n in range(1, levels + 1)))
    return headings.withColumn(name, F.element_at(ends, F.col(level).cast("int")))


def in_force(rows: DataFrame, keys: Sequence[str], order: str, value: Column, default, name: str) -> DataFrame:
    """Add the last value that is not null up to each row, or the default."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))
