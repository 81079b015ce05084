"""Removal of repeated line windows across a corpus.

Every document is cut at newlines; each run of `window` consecutive lines is hashed (128 bits). Windows
whose hash occurs more than once in the corpus keep their first occurrence, by (id, digest of the text,
position), ids that are null first. Every later occurrence is removed: the positions it covers are merged
with those of the document's other removed windows.

Defined results: a null text stays null with 0 lines; a text of fewer lines than a window is unchanged;
rows with the same id and the same text are one occurrence and get the same result, once for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def text_key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def window_digests(text: str, window: int) -> list[bytes]:
    lines = text.split("\n")
    each = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
    return [hashlib.blake2b(b"".join(each[i : i + window]), digest_size=16).digest() for i in range(len(lines) - window + 1)]


def without_lines(text: str, starts: list[int], window: int) -> tuple[str, int, int]:
    """The text without lines covered by windows at starts; its lines, and how many of them went."""
    lines = text.split("\n")
    change = np.zeros(len(lines) + 1, np.int32)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.asarray(starts, np.int64) + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Rows (id_col, n_lines, n_removed, text_col): each document without the later occurrences of repeated windows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            at, pos, key, dig = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is not None and (d := window_digests(t, window)):
                    k = text_key(t)
                    at += [i] * len(d)
                    pos += range(len(d))
                    key += [k] * len(d)
                    dig += d
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(key, pa.binary()), pa.array(pos, pa.int32()), pa.array(dig, pa.binary())]
            schema = schema or pa.schema([("id", cols[0].type), ("key", pa.binary()), ("pos", pa.int32()), ("digest", pa.binary())])
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    cut = materialize(rows.mapInArrow(windows, f"id {id_type}, key binary, pos int, digest binary"), "windows")
    place = F.struct("id", "key", "pos")
    repeated = materialize(
        cut.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"),
        "repeated",
    )
    later = cut.join(repeated, "digest").filter(~place.eqNullSafe(F.col("first")))
    removed = later.groupBy("id", "key").agg(F.collect_set("pos").alias("starts"))

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else text_key(t))

    @F.pandas_udf("struct<text string, n_lines int, n_removed int>")
    def clean(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, starts, strict=True):
            if t is None:
                out.append((None, 0, 0))
            elif s is None or not len(s):
                out.append((t, t.count("\n") + 1, 0))
            else:
                out.append(without_lines(t, list(s), window))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    keyed = rows.withColumn("key", key_of("text")).alias("d")
    removed = removed.alias("r")
    joined = keyed.join(removed, F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.key") == F.col("r.key")), "left")
    return joined.select(F.col("d.id").alias("id"), clean(F.col("d.text"), F.col("r.starts")).alias("c")).select(F.col("id").alias(id_col), "c.n_lines", "c.n_removed", F.col("c.text").alias(text_col))
