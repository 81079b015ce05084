"""Exact maximum inner product search with pruning by norm buckets.

Vectors are cut to integers and written, by ranges of their length, from the longest to the shortest; buckets are runs
of that order, so they hold similar lengths. A first pass of the queries over SEEDS candidates (the longest, and as many
spread by a hash) gives each query the k-th best product that it surely reaches, its floor s. In a bucket whose longest
vector has length L a query needs a cosine of at least s / (|q| * L). If that local threshold exceeds 1 the bucket is
passed over. For a high one, candidates shorter than s / |q| are passed over (length pruning), then those whose products
over the few coordinates that matter most in the bucket, with Cauchy's bound for the rest, stay below s (coordinate
pruning); for a low one all products of the bucket are made. What is left is verified by exact integer products.
Floors rise as a task goes from long vectors to short ones.

Queries travel in blocks of at most `block_bytes`, so what is sent to the executors has a fixed size; each block is one
pass over the candidates, whose findings (at most k rows for each query and task) are written before the next.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part; only
vectors of equal dimension are compared; rows, not ids, are candidates: a query meets every row but its own, also such
that have its id or its vector, and repeated rows each count; ids that are null take no part. Ids may be of any
type that sorts. Scores beyond 64 bits are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialize, new_path

#: Rows of one norm bucket; rows of a range of lengths, and the most ranges; seeds of either kind.
BUCKET, RANGE, RANGES, SEEDS = 512, 4_096, 10_000, 1_024
SCALE = 256
#: Local cosine thresholds from which a bucket is pruned by length and coordinates.
HIGH = 0.5


def quantized(values: list) -> np.ndarray | None:
    """floor(256 * x) of each component as doubles, or None if the vector takes no part."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    v = np.floor(np.asarray(values, np.float64) * SCALE)
    return v if np.isfinite(v).all() else None


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows, as int64 (clipped): by doubles where every sum stays below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    big = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    lim = 2**63 - 1
    return np.array([[max(-lim - 1, min(lim, v)) for v in row] for row in big], dtype=np.int64)


class TopK:
    """Best k (score, smaller id first) for each query of one dimension, kept while candidates pass by in buckets.

    rows: numbers of the queries' own rows; floors: scores that each query's k-th best surely reaches.
    """

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.rows, self.q, self.k = rows, vectors, k
        self.norms = np.sqrt((vectors**2).sum(1))
        least = np.iinfo(np.int64).min
        self.floor = np.full(len(rows), least, np.int64) if floors is None else floors.astype(np.int64)
        self.best: list[list[tuple[int, object, int]]] = [[] for _ in rows]  # (-score, id, row)
        self.made = self.met = 0  # products made, pairs met

    def bucket(self, rows: np.ndarray, ids: list, vectors: np.ndarray, norms: np.ndarray) -> None:
        """One bucket, norms descending."""
        self.met += len(self.rows) * len(rows)
        floor = np.where(self.floor == np.iinfo(np.int64).min, -np.inf, self.floor.astype(np.float64))
        slack = 1e-6 + 1e-12 * self.norms * norms[0]
        bound = self.norms * norms[0]
        active = np.flatnonzero(floor <= bound + slack)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound > 0, floor / bound, -np.inf)
        low = active[cosine[active] <= HIGH]
        high = active[cosine[active] > HIGH]
        if len(low):
            self._verify(low, rows, ids, vectors)
        if not len(high):
            return
        # length pruning: the longest candidates that the least demanding of these queries can use
        least = (floor[high] - slack[high]) / self.norms[high]
        m = int(np.searchsorted(-norms, -least.min(), side="right"))
        q, c = self.q[high], vectors[:m]
        few = max(1, c.shape[1] // 4) if c.shape[1] > 1 else 1
        focus = np.argsort(-((q**2).sum(0) * (c**2).sum(0)), kind="stable")[:few]
        qf, cf = q[:, focus], c[:, focus]
        rest_q = np.sqrt(np.maximum(0.0, (q**2).sum(1) - (qf**2).sum(1)))
        rest_c = np.sqrt(np.maximum(0.0, (c**2).sum(1) - (cf**2).sum(1)))
        most = qf @ cf.T + rest_q[:, None] * rest_c[None, :]  # coordinate pruning
        left = (most + slack[high][:, None] >= floor[high][:, None]) & (norms[:m][None, :] >= least[:, None])
        many = left.sum(1)
        whole = many * 4 > m
        if whole.any():
            self._verify(high[whole], rows[:m], ids[:m], c)
        for i in np.flatnonzero((many > 0) & ~whole):
            at = np.flatnonzero(left[i])
            self._verify(high[i : i + 1], rows[at], [ids[j] for j in at], c[at])

    def _verify(self, of: np.ndarray, rows: np.ndarray, ids: list, vectors: np.ndarray) -> None:
        for start in range(0, len(of), 4096):
            r = of[start : start + 4096]
            s = products(self.q[r], vectors)
            self.made += s.size
            hit = (s >= self.floor[r][:, None]) & (rows[None, :] != self.rows[r][:, None])
            for j in np.flatnonzero(hit.any(1)):
                self._merge(r[j], np.flatnonzero(hit[j]), s[j], rows, ids)

    def _merge(self, i: int, at: np.ndarray, score: np.ndarray, rows: np.ndarray, ids: list) -> None:
        if len(at) > self.k:
            s = score[at]
            at = at[s >= np.partition(s, -self.k)[-self.k]]
        best = sorted([*self.best[i], *((-int(score[j]), ids[j], int(rows[j])) for j in at)])[: self.k]
        self.best[i] = best
        if len(best) == self.k:
            self.floor[i] = max(self.floor[i], -best[-1][0])


def exact_topk(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """Rows (query_id, rank, <id_col>, score) of the k best candidates of each row for which the condition is_query holds."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf"))))
    table = by_length(rows)
    queries = table.filter("q")
    total = queries.agg(F.count("*"), F.sum(F.size("v"))).first()
    kind = table.schema["id"].dataType.simpleString()
    if not total[0]:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score long")
    parts = max(1, -(-int(total[1]) * 8 // block_bytes))
    seeded = materialize(_seeded(queries, table, k).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "queries")
    path = new_path(rows.sparkSession, "found")
    for p in range(parts):
        own = seeded.filter(F.col("part") == p).select("row", "id", "v", "floor").toArrow()
        if own.num_rows:
            _pass(table, _by_dim(own), k, kind).write.mode("append").parquet(path)
    found = rows.sparkSession.read.schema(f"query_row long, query_id {kind}, id {kind}, row long, score long").parquet(path)
    # at most k rows of each task for a query, cut to k map side first
    w = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def by_length(rows: DataFrame) -> DataFrame:
    """The rows, numbered, in files by ranges of length, each from the longest vector to the shortest; a hash parts those of equal length."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * SCALE), F.lit(2.0)))
    n = rows.count()
    ranged = rows.withColumns({"length": length, "salt": F.xxhash64("id", "v")}).repartitionByRange(max(1, min(RANGES, -(-n // RANGE))), F.desc("length"), "salt")
    ordered = ranged.sortWithinPartitions(F.desc("length"), "salt").withColumn("row", F.monotonically_increasing_id())
    return materialize(ordered.select("id", "v", "q", "row", "length", "salt"), "by_length")


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, quantised vectors) of the rows of a batch (columns row, id, v) that have one dimension."""
    col = b.column(2)
    first = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(first)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.floor(flat[first[at][:, None] + np.arange(d)] * SCALE)


def _by_dim(own: pa.Table) -> dict[int, tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """dimension -> (row numbers, ids, vectors, floors)."""
    out: dict[int, list] = {}
    for b in own.to_batches():
        floors = b.column(3).to_numpy(zero_copy_only=False)
        for at, m in _matrices(b):
            out.setdefault(m.shape[1], []).append((b.column(0).to_numpy()[at], b.column(1).take(pa.array(at)).to_pylist(), m, floors[at]))
    return {d: (np.concatenate([x[0] for x in xs]), [i for x in xs for i in x[1]], np.concatenate([x[2] for x in xs]), np.concatenate([x[3] for x in xs])) for d, xs in out.items()}


def _seeded(queries: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Queries (row, id, v) with `floor`: the k-th best score over the seeds, the least long where there are fewer."""
    each = table.select("row", "id", "v", F.lit(0).cast("long").alias("floor"), "length", "salt")
    seeds = pa.concat_tables([each.orderBy(F.desc("length"), "salt").limit(SEEDS).toArrow(), each.orderBy("salt").limit(SEEDS).toArrow()])
    seeds = seeds.select(["row", "id", "v", "floor"])
    sent = queries.sparkSession.sparkContext.broadcast(_by_dim(seeds))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, np.iinfo(np.int64).min, np.int64)
            own = b.column(0).to_numpy()
            for at, m in _matrices(b):
                if m.shape[1] not in sent.value:
                    continue
                rows, _, vectors, _ = sent.value[m.shape[1]]
                rows, first = np.unique(rows, return_index=True)  # a seed of both kinds counts once
                s = products(m, vectors[first])
                s[rows[None, :] == own[at][:, None]] = np.iinfo(np.int64).min
                if s.shape[1] >= k:
                    out[at] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], names=["row", "id", "v", "floor"])

    rows = queries.select("row", "id", "v")
    return rows.mapInArrow(floors, f"row long, id {rows.schema['id'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, floor long")


def _pass(table: DataFrame, queries: dict[int, tuple[np.ndarray, list, np.ndarray, np.ndarray]], k: int, kind: str) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {d: TopK(rows, q, k, floors) for d, (rows, _, q, floors) in sent.value.items()}
        id_type = pa.int64()
        for b in batches:
            numbers, id_type = b.column(0).to_numpy(), b.schema.field(1).type
            for at, m in _matrices(b):
                if m.shape[1] not in tops:
                    continue
                norms = np.sqrt((m**2).sum(1))
                order = np.argsort(-norms, kind="stable")
                for s in range(0, len(order), BUCKET):
                    o = order[s : s + BUCKET]
                    tops[m.shape[1]].bucket(numbers[at[o]], b.column(1).take(pa.array(at[o])).to_pylist(), m[o], norms[o])
        cols: list[list] = [[], [], [], [], []]
        for d, t in tops.items():
            for row, i, best in zip(t.rows.tolist(), sent.value[d][1], t.best, strict=True):
                for score, who, at_row in best:
                    for c, x in zip(cols, (row, i, who, at_row, -score), strict=True):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], id_type), pa.array(cols[2], id_type), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["query_row", "query_id", "id", "row", "score"])

    return table.select("row", "id", "v").mapInArrow(search, f"query_row long, query_id {kind}, id {kind}, row long, score long")
