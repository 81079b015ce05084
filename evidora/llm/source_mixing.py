"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed pseudo-random order and cut into blocks of about `block_chars`
characters. A source of weight w (its share of slots, an exact fraction) releases its j-th block, counted from 0, at
slot floor(j / w) and must place it before slot ceil((j + 1) / w). Slots go to the released block with the earliest
deadline. At every slot each source has had its due within less than one block, however long the schedule is. When a
source has no blocks left the others go on with their weights scaled up (a new phase); there are at most as many phases
as sources. Every document is kept and placed once.

The slots of a phase are cut into chunks of D slots, D at least `period` and 1 / w of the lightest source, and chunks
are scheduled on the executors, each by itself. What each source has had at a chunk's end T is found by running D
slots up to T from the state that rounds up the dues of the sources with the earliest deadlines; from that state no
deadline is missed, and as each weight is due a block in a chunk, the schedule between two such ends exists, and earliest
deadline first finds it. The driver runs the slots from the last whole chunk to the end of each phase.

A document belongs to the block in which it begins; a document longer than a block leaves the numbers that it
covers without documents. Running totals within a source are made over hash buckets, over runs of buckets and over
these, so that a source of any size is dealt over many tasks; rows that are equal are told apart by their place in the files.

Defined results: a null source is a source of its own; null texts have length 0; repeated rows are placed
each; sources without a given weight share `rest` equally (weights are relative).
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialize, small_side

NULL = "\x00null"
ROWS_PER_BUCKET = 1_000
#: Buckets of a run.
RUN = 4_096


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in the exact proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(x <= 0 for x in exact.values()):
        raise ValueError("weights must be above 0")
    common = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    whole = {s: int(x * common) for s, x in exact.items()}
    shared = math.gcd(*whole.values()) if whole else 1
    return {s: n // shared for s, n in whole.items()}


@dataclass
class Phase:
    """A run of slots in which the sources `nums` (whole weights) all have blocks left; the k-th slot is number base + k."""

    nums: dict[str, int]
    first: dict[str, int]  # blocks that a source has had before
    base: int
    chunk: int
    chunks: int = 0
    slots: int = 0

    def __post_init__(self) -> None:
        self.total = sum(self.nums.values())

    def release(self, s: str, j: int) -> int:
        return j * self.total // self.nums[s]

    def deadline(self, s: str, j: int) -> int:
        return -(-(j + 1) * self.total // self.nums[s])

    def rounded(self, t: int) -> dict[str, int]:
        """Dues at slot t, rounded up for the sources with the earliest deadlines and down for the others."""
        down = {s: t * n // self.total for s, n in self.nums.items()}
        part = sorted((Fraction((down[s] + 1) * self.total, n), s) for s, n in self.nums.items() if t * n % self.total)
        for _, s in part[: t - sum(down.values())]:
            down[s] += 1
        return down

    def run(self, t: int, stop: int, had: dict[str, int], until: dict[str, int] | None = None) -> Iterator[tuple[int, str, int]]:
        """(slot, source, block) from slot t on by earliest deadline, `had` counting up; blocks below `until` only, if given, and done by stop."""
        heap: list[tuple[int, str]] = []
        waiting: list[tuple[int, str]] = []

        def put(s: str) -> None:
            if until is None or had[s] < until[s]:
                heapq.heappush(waiting, (self.release(s, had[s]), s))

        for s in self.nums:
            put(s)
        while t < stop:
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(heap, (self.deadline(s, had[s]) if until is None else min(stop, self.deadline(s, had[s])), s))
            deadline, s = heapq.heappop(heap)
            if deadline <= t:
                raise AssertionError(f"a block of {s} misses slot {deadline}")
            yield t, s, had[s]
            had[s] += 1
            put(s)
            t += 1

    def state(self, k: int) -> dict[str, int]:
        """What each source has had when k chunks are over."""
        if not k:
            return dict.fromkeys(self.nums, 0)
        had = self.rounded((k - 1) * self.chunk)
        for _ in self.run((k - 1) * self.chunk, k * self.chunk, had):
            pass
        return had

    def part(self, k: int) -> Iterator[tuple[int, str, int]]:
        """(slot, source, block) of chunk k; the last, numbered `chunks`, goes to the end of the phase."""
        if k == self.chunks:
            return self.run(k * self.chunk, self.slots, self.state(k))
        return self.run(k * self.chunk, (k + 1) * self.chunk, self.state(k), self.state(k + 1))


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> list[Phase]:
    """The phases of the schedule of blocks, each ending when a source has none left."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    base, out = 0, []
    while left:
        nums = whole_weights({s: weights[s] for s in left})
        total = sum(nums.values())
        p = Phase(nums, {s: done[s] for s in left}, base, max(period, -(-total // min(nums.values()))))
        p.chunks = min((left[s] - 1) * total // n for s, n in nums.items()) // p.chunk  # until then no source can end
        had = p.state(p.chunks)
        for t, s, _ in p.run(p.chunks * p.chunk, 1 << 62, had):
            if had[s] + 1 == left[s]:
                had[s] += 1
                p.slots = t + 1
                break
        out.append(p)
        base += p.slots
        for s in list(left):
            done[s] += had[s]
            left[s] -= had[s]
            if not left[s]:
                del left[s]
    return out


def schedule(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """(p_source, block, slot, release, deadline) of every block, made by the executors chunk by chunk."""
    ends = list(itertools.accumulate(p.chunks + 1 for p in plan))
    sent = spark.sparkContext.broadcast((plan, ends))
    many = ends[-1] if ends else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, ends = sent.value
        for b in batches:
            for n in b.column(0).to_pylist():
                i = bisect.bisect_right(ends, n)
                p, k = plan[i], n - (ends[i - 1] if i else 0)
                found = list(p.part(k))
                cols = [[s for _, s, _ in found], [p.first[s] + j for _, s, j in found], [p.base + t for t, _, _ in found], [p.base + p.release(s, j) for _, s, j in found], [p.base + p.deadline(s, j) for _, s, j in found]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["p_source", "block", "slot", "release", "deadline"])

    return spark.range(0, many, 1, max(1, min(many, 10_000))).mapInArrow(run, "p_source string, block long, slot long, release long, deadline long")


def _with_place(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs, and a column that tells their rows apart: the place in the files they are read from, written here if they are read from none."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        if "_metadata" not in docs.columns:
            docs.select(place)  # fails for rows that are not read from files
            return docs, place
    except AnalysisException:
        pass
    return materialize(docs, "unmixed"), place


def placed(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_chars: int = 65_536, period: int = 1000, rest: float = 0.0, keep: bool = False) -> DataFrame:
    """Each row with its place: block, slot, release, deadline (and mix_order, by which rows of a slot follow).

    weights: targets by source; None: each source's characters to the given power. keep: all columns stay, as the struct `row`.
    """
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    docs, place = _with_place(docs)
    extra = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep else []
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NULL)).alias("source"),
        size.alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("mix"), F.xxhash64(F.col(text_col).cast("string"))).alias("ord"),
        place.alias("tie"),
        *extra,
    )
    spark = docs.sparkSession
    totals = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).collect()  # as many as sources
    names = {r["source"]: r for r in totals}
    sizes = [(s, -(-r["n"] // ROWS_PER_BUCKET)) for s, r in names.items()]
    rows = rows.join(small_side(spark.createDataFrame(sizes, "source string, buckets long"), len(sizes)), "source")
    bucket = F.floor(F.pmod(F.col("ord"), F.lit(1 << 40)) * F.col("buckets") / F.lit(1 << 40)).cast("long")
    rows = rows.withColumn("bucket", bucket).drop("buckets")
    # rows that are equal fall into one bucket: large ones are dealt out by the place of their rows
    large = rows.groupBy("source", "bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > 4 * ROWS_PER_BUCKET)
    large = materialize(large.select("source", "bucket", F.ceil(F.col("_n") / ROWS_PER_BUCKET).alias("subs")), "large")
    rows = rows.join(small_side(large), ["source", "bucket"], "left")
    rows = rows.withColumn("sub", F.coalesce(F.pmod(F.col("tie"), F.col("subs")), F.lit(0)).cast("long")).drop("subs")
    if weights is None:
        given = {s: float(max(1, r["chars"])) ** power for s, r in names.items()}
    else:
        unnamed = [s for s in names if s not in weights]
        given = {s: weights.get(s, (rest or min(weights.values()) / 10) / max(1, len(unnamed))) for s in names}
    sums = materialize(rows.groupBy("source", "bucket", "sub").agg(F.sum("size").alias("in_bucket")), "sums")
    sums = sums.withColumns({"run": F.floor(F.col("bucket") / RUN), "sub_run": F.floor(F.col("sub") / RUN)})
    before = lambda w: F.coalesce(F.sum("in_bucket").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("source", "run", "sub_run").agg(F.sum("in_bucket").alias("in_bucket"))
    # runs of buckets, and of the parts of a large bucket, which follow in order
    runs = runs.select("source", "run", "sub_run", before(W.partitionBy("source").orderBy("run", "sub_run")).alias("_runs"))
    inner_sums = sums.select("source", "run", "sub_run", "bucket", "sub", before(W.partitionBy("source", "run", "sub_run").orderBy("bucket", "sub")).alias("_in_run"))
    sums = materialize(inner_sums.join(runs, ["source", "run", "sub_run"]).select("source", "bucket", "sub", (F.col("_runs") + F.col("_in_run")).alias("offset")), "offsets")
    inner = W.partitionBy("source", "bucket", "sub").orderBy("ord", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(small_side(sums), ["source", "bucket", "sub"])
    rows = rows.withColumn("block", F.floor((F.col("offset") + F.col("within")) / F.lit(block_chars)).cast("long"))
    blocks = {s: r["chars"] // block_chars + 1 for s, r in names.items()}  # a document of length 0 may begin at the very end
    plan = phases(blocks, given, period)
    table = materialize(schedule(spark, plan), "schedule")
    out = rows.join(small_side(table, sum(p.slots for p in plan)).withColumnRenamed("block", "p_block"), (F.col("source") == F.col("p_source")) & (F.col("block") == F.col("p_block")))
    cols = [F.col("id").alias(id_col), F.when(F.col("source") != NULL, F.col("source")).alias(source_col), "block", "slot", "release", "deadline", F.struct("ord", "tie").alias("mix_order")]
    return out.select(*cols, *(["row"] if keep else []))


def source_mixing(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """Rows (id_col, source_col, block, slot, release, deadline), one for each input row."""
    return placed(docs, id_col=id_col, source_col=source_col, **options).drop("mix_order")


def in_mixed_order(docs: DataFrame, rows_per_part: int = 20_000, **options) -> DataFrame:
    """The rows and columns of docs, in files and within files in the order of the mix."""
    n = docs.count()
    at = placed(docs, keep=True, **options)
    parts = max(1, -(-n // rows_per_part))
    ordered = at.repartitionByRange(parts, "slot", "mix_order").sortWithinPartitions("slot", "mix_order")
    return ordered.select("row.*")

