"""Joins on spans and bands, made of equi joins: keys first, then buckets, then the exact condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shuffle_tasks, spread


def _bucketed(df: DataFrame, start: str, end: str, width, name: str = "_bucket") -> DataFrame:
    """A row for each bucket that the half-open span [start, end) touches."""
    last = F.greatest(F.col(start), F.col(end) - 1) if isinstance(width, int) else F.col(end)
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_semi(spans: DataFrame, marks: DataFrame, keys: Sequence[str], start: str, end: str, m_start: str, m_end: str, width: int = 64) -> DataFrame:
    """Rows of spans that share a point with a mark of the same keys. Integer offsets.

    Both sides are dealt by key and bucket of `width`, so one document with many marks is many groups.
    """
    cols = spans.columns
    x = _bucketed(spans.filter(F.col(start) < F.col(end)), start, end, width)
    y = _bucketed(marks.filter(F.col(m_start) < F.col(m_end)).select(*keys, F.col(m_start).alias("_ms"), F.col(m_end).alias("_me")), "_ms", "_me", width)
    on = [x[k] == y[k] for k in [*keys, "_bucket"]] + [x[start] < y["_me"], y["_ms"] < x[end]]
    return x.join(y, on, "left_semi").select(*cols).distinct()


def locators(spans: DataFrame, words: DataFrame, keys: Sequence[str], span_id: Sequence[str], start: str, end: str, w_start: str, w_end: str, page: str, box: Sequence[str]) -> DataFrame:
    """Each span's first page and the box of its words there: (span_id, page, x0, y0, x1, y1). Its join has tasks by the number of words and spans."""
    n = shuffle_tasks(spans, words)
    spans, words = spread(spans, n, *keys), spread(words, n, *keys)
    x0, y0, x1, y1 = box
    s = spans.select(*dict.fromkeys([*keys, *span_id]), F.col(start).alias("_s"), F.col(end).alias("_e"))
    on = [s[k] == words[k] for k in keys] + [s["_s"] < words[w_end], words[w_start] < s["_e"]]
    hit = s.join(words, on).select(*(s[c] for c in span_id), words[page].alias("page"), *(words[b].alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))
    boxes = hit.groupBy(*span_id, "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    first = boxes.groupBy(*span_id).agg(F.min(F.struct("page", "x0", "y0", "x1", "y1")).alias("_b"))
    return first.select(*span_id, "_b.*")


def band_pairs(rows: DataFrame, keys: Sequence[str], row_id: str, value: str, band: float) -> DataFrame:
    """Pairs (a, b), a before b, of rows with the same keys whose values differ by at most `band`.

    Rows meet in buckets as wide as the band; the right side also looks into its neighbours.
    """
    cell = F.floor(F.col(value) / band).cast("long")
    left = rows.select(*keys, F.col(row_id).alias("a"), F.col(value).alias("value_a"), cell.alias("_cell"))
    right = rows.select(*keys, F.col(row_id).alias("b"), F.col(value).alias("value_b"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    pairs = left.join(right, [*keys, "_cell"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("value_a") - F.col("value_b")) <= band))
    return pairs.select(*keys, "a", "b", "value_a", "value_b")


def contained_names(names: DataFrame, name: str) -> DataFrame:
    """Pairs (inner, outer) of distinct names, inner a run of outer's words: by equality with every shorter run, not by comparing all names."""
    base = names.select(F.col(name).alias("outer")).filter(F.col("outer").isNotNull()).distinct()
    w = base.withColumn("w", F.split("outer", " ")).withColumn("n", F.size("w"))
    starts = w.withColumn("i", F.explode(F.expr("sequence(1, n)")))
    runs = starts.withColumn("k", F.explode(F.expr("sequence(1, n - i + 1)"))).filter(F.col("k") < F.col("n"))
    runs = runs.select("outer", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("inner")).distinct()
    return runs.join(base.select(F.col("outer").alias("inner")), "inner").select("inner", "outer")
