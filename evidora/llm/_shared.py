"""What the operators of this subpackage share: reading tables, the shared folder, packed word hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import give_back as give_back
from ..arrow import pieces as pieces
from ..session import ship as ship
from ..tables import materialize as materialize
from ..tables import new_path as new_path
from ..tables import release as release

WORD = re.compile(r"\w+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs, columns as they are, for whose texts `keep` says so; it is asked piece by piece."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            yield b.filter(pa.array(keep(b.column(column).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Largest number of rows that small_side() lets a join broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most `most` rows of a fixed small width; else df as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordIds:
    """Dense ids of words within a batch, and a 64-bit hash of each word."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        import xxhash

        f = xxhash.xxh64_intdigest
        return np.fromiter((f(w) for w in self.ids), np.uint64, len(self.ids))


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole run if it is shorter; none for no words."""
    k = len(word_hashes)
    if k == 0:
        return np.empty(0, np.uint64)
    m = min(n, k)
    out = np.zeros(k - m + 1, np.uint64)
    for i in range(m):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : k - m + 1 + i]
        out ^= out >> np.uint64(29)
    return mixed(out + np.uint64(m))
