"""Windows of texts for extraction: fixed steps, or cut at line breaks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id_col, start, end, text): windows of `size` code points, each `overlap` before the end of the one before. Columns only."""
    step, n = size - overlap, F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = docs.withColumn("_i", F.explode(starts)).withColumn("start", (F.col("_i") * step).cast("long"))
    end = F.least(n.cast("long"), F.col("start") + size)
    return rows.withColumn("end", end).select(id_col, "start", "end", F.col(text_col).substr(F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("text"))


def windows_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most `size` code points that end at the last line break of their second half, if it has one."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + size)
        if stop < n and (cut := text.rfind("\n", at + (stop - at) // 2, stop)) >= 0:
            stop = cut + 1
        yield at, stop
        if stop == n:
            break
        at = max(at + 1, stop - overlap)


def char_windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id_col, start, end): windows_of() of each text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, s, e) for i, t in enumerate(b.column(1).to_pylist()) if t for s, e in windows_of(t, size, overlap)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["id", "start", "end"])

    return rows.mapInArrow(cut, f"id {kind}, start long, end long").withColumnRenamed("id", id_col)
