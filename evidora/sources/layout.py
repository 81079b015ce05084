"""Word boxes of pages: places, lines, tables by gaps, and cells of ruled grids."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def places(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end, page, x0, y0, x1, y1): boxes in hundredths, rounded to even; a word that begins before an earlier one ends is left out."""
    w = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    free = words.withColumn("_far", F.max("end").over(w)).filter((F.col("start") < F.col("end")) & (F.col("_far").isNull() | (F.col("start") >= F.col("_far"))))
    hundredths = lambda c: F.bround(F.col(c) * 100).cast("int")
    return free.select(*keys, "start", "end", "page", hundredths("x0").alias("x0"), hundredths("top").alias("y0"), hundredths("x1").alias("x1"), hundredths("bottom").alias("y1"))


def lines_of(words: Iterable[dict[str, Any]]) -> list[list[dict[str, Any]]]:
    """Words of a page in lines: those that overlap by half of the lesser height, in order of x."""
    out: list[list[dict[str, Any]]] = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"])):
        for line in out[-3:]:
            top, bottom = max(w["top"], line[0]["top"]), min(w["bottom"], line[0]["bottom"])
            if bottom - top >= 0.5 * min(w["bottom"] - w["top"], line[0]["bottom"] - line[0]["top"]):
                line.append(w)
                break
        else:
            out.append([w])
    return [sorted(x, key=lambda w: w["x0"]) for x in out]


def gap_columns(lines: Sequence[Sequence[dict[str, Any]]], gap: float) -> list[tuple[float, float]]:
    """Columns that the lines share: x ranges between gaps of at least `gap` that no word of any line crosses."""
    spans = sorted((w["x0"], w["x1"]) for line in lines for w in line)
    out: list[list[float]] = []
    for a, b in spans:
        if out and a - out[-1][1] < gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def table_rows(words: Iterable[dict[str, Any]], gap: float = 12.0, least_rows: int = 2) -> list[list[list[str]]]:
    """Tables of a page: runs of lines that have two columns or more, as rows of cell texts; empty cells stay."""
    lines, out, run = lines_of(words), [], []

    def close() -> None:
        if len(run) >= least_rows:
            columns = gap_columns(run, gap)
            if len(columns) >= 2:
                out.append([[" ".join(w["text"] for w in line if a <= w["x0"] <= b) for a, b in columns] for line in run])

    for line in lines:
        wide = any(b["x0"] - a["x1"] >= gap for a, b in zip(line, line[1:], strict=False))
        if wide or run and len(line) == 1 and len(gap_columns([*run, line], gap)) == len(gap_columns(run, gap)):
            run.append(line)
        else:
            close()
            run = []
    close()
    return out


def _joined(segments: Iterable[tuple[float, float, float]], near: float) -> list[tuple[float, float, float]]:
    """Segments (at, from, to) on nearly the same line that touch, joined."""
    out: list[list[float]] = []
    for at, a, b in sorted((round(at / near) * near, min(a, b), max(a, b)) for at, a, b in segments):
        if out and out[-1][0] == at and a <= out[-1][2] + near:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([at, a, b])
    return [(x, a, b) for x, a, b in out]


def grid_cells(horizontal: Iterable[tuple[float, float, float]], vertical: Iterable[tuple[float, float, float]], near: float = 2.0) -> list[tuple[int, int, tuple[float, float, float, float]]]:
    """Cells (row, column, box) of ruled grids: horizontal (y, x0, x1) and vertical (x, y0, y1) rules that meet in components."""
    hs, vs = _joined(horizontal, near), _joined(vertical, near)
    parent = list(range(len(hs) + len(vs)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (y, x0, x1) in enumerate(hs):
        for j, (x, y0, y1) in enumerate(vs):
            if x0 - near <= x <= x1 + near and y0 - near <= y <= y1 + near:
                parent[find(i)] = find(len(hs) + j)
    out = []
    for root in sorted({find(i) for i in range(len(parent))}):
        ys = sorted({h[0] for i, h in enumerate(hs) if find(i) == root})
        xs = sorted({v[0] for j, v in enumerate(vs) if find(len(hs) + j) == root})
        for r, (top, bottom) in enumerate(zip(ys, ys[1:], strict=False)):
            for c, (left, right) in enumerate(zip(xs, xs[1:], strict=False)):
                out.append((r, c, (left, top, right, bottom)))
    return out


def ocr_words(spark, path: str) -> DataFrame:
    """Words and confidences (0 to 1) of a recogniser's TSV output: (page, block, line, word, x0, top, x1, bottom, confidence, text)."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    n = lambda c: F.expr(f"try_cast({c} AS double)")
    rows = raw.filter((F.col("level") == "5") & (F.trim("text") != "") & (n("conf") >= 0))
    return rows.select(
        n("page_num").cast("int").alias("page"), n("block_num").cast("int").alias("block"), n("line_num").cast("int").alias("line"), n("word_num").cast("int").alias("word"),
        n("left").alias("x0"), n("top").alias("top"), (n("left") + n("width")).alias("x1"), (n("top") + n("height")).alias("bottom"), (n("conf") / 100).alias("confidence"), "text",
    )
