"""Token ids in packed rows of fixed length.

Texts are split by a tiktoken vocabulary and end with an end token. Documents longer than a row are split
losslessly into pieces. The pieces of a group (what a task reads, up to `group_tokens`) are packed
best-fit decreasing: longest first, each into the open row with the least room that still holds it; a segment
tree over room sizes finds that row. Every packed row has its ids (padded), the cumulative lengths of its segments
and positions that start again at 0 with each segment; and where each segment comes from, so that the texts can
be put together again. write_packed() writes rows of one width as matrices of up to `rows` rows: their ids and positions as
little-endian bytes, row after row, and the cumulative lengths of all rows with the offset at which each row's begin.

Defined results: a null or empty text is a document of the end token alone; repeated rows and repeated ids are
packed each (segments carry a running number of the document within its task); special token strings are text. A document of
more than `group_tokens` goes on in the next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces
from .secret_scan import load_vocabulary

#: The splitting pattern of the vocabulary's library (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Rooms:
    """Open rows by room: a segment tree whose leaves are room sizes 0..size and hold how many open rows have it."""

    def __init__(self, size: int) -> None:
        self.n = 1
        while self.n <= size:
            self.n *= 2
        self.tree = [0] * (2 * self.n)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.n
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least need, which is taken out."""
        i = need + self.n
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.n
        row = self.rows[room].pop()
        while i:
            self.tree[i] -= 1
            i >>= 1
        return room, row


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers; each row's pieces fit into size."""
    rooms, rows = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = rooms.take(lengths[i])
        if got is None:
            rows.append([])
            got = (size, len(rows) - 1)
        room, row = got
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack_group(parts: list[tuple[object, int, int, np.ndarray]], size: int, pad: int) -> Iterator[dict]:
    """Packed rows of parts of documents: (id, running number, place of the part in the document, token ids)."""
    pieces = [(d, s, min(size, len(p[3]) - s)) for d, p in enumerate(parts) for s in range(0, len(p[3]), size)]
    for number, row in enumerate(best_fit([n for _, _, n in pieces], size)):
        ids, position = np.full(size, pad, np.uint32), np.zeros(size, np.uint32)
        ends, segments, at = [0], [], 0
        for p in row:
            d, s, n = pieces[p]
            ids[at : at + n] = parts[d][3][s : s + n]
            position[at : at + n] = np.arange(n)
            at += n
            ends.append(at)
            segments.append({"id": parts[d][0], "document": parts[d][1], "start": parts[d][2] + s, "length": n})
        narrow = ids.max() < 1 << 16
        yield {"row": number, "n_tokens": at, "width": 2 if narrow else 4, "ids": ids.astype("<u2" if narrow else "<u4").tobytes(), "cu_seqlens": ends, "positions": position.astype("<u2" if size <= 1 << 16 else "<u4").tobytes(), "segments": segments}


def token_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", end_token: int = 50256, group_tokens: int = 2_000_000) -> DataFrame:
    """Rows (grp, row, n_tokens, width, ids, cu_seqlens, positions, segments). ids: little-endian, `width` bytes each.

    grp: task and running number of a group, as text. The end token's id also fills the end of a row; n_tokens
    tells where that begins.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, task = encoder(ranks.value), TaskContext.get().partitionId()
        schema, group, held, number, document = None, [], 0, 0, 0

        def out() -> pa.RecordBatch:
            made = list(pack_group(group, size, end_token))
            cols = [pa.array([f"{task}-{number}"] * len(made)), *(pa.array([m[c] for m in made], schema.field(c).type) for c in schema.names[1:])]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in pieces(batches, 1):
            if schema is None:
                segment = pa.struct([("id", b.schema.field(0).type), ("document", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])
                schema = pa.schema([("grp", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("segments", pa.list_(segment))])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*(coder.encode_ordinary(t) if t else ()), end_token], np.uint32)
                at = 0
                while at < len(ids):
                    room = group_tokens - held
                    take = ids[at:] if len(ids) - at <= room else ids[at : at + max(size, room // size * size)]  # cut at whole rows
                    group.append((i, document, at, take))
                    at += len(take)
                    held += len(take)
                    if held >= group_tokens - size:
                        yield out()
                        group, held, number = [], 0, number + 1
                document += 1
        if group:
            yield out()

    return rows.mapInArrow(pack, f"grp string, row int, n_tokens int, width int, ids binary, cu_seqlens array<int>, positions binary, segments array<struct<id:{kind},document:int,start:bigint,length:int>>")


MATRIX = "matrix string, n_rows int, size int, width int, ids binary, positions binary, cu_seqlens array<int>, cu_offsets array<int>, rows array<struct<grp:string,row:int,n_tokens:int,segments:{segments}>>"


def write_packed(packed: DataFrame, path: str, size: int = 2048, rows: int = 32) -> DataFrame:
    """Write packed rows as Parquet rows of one matrix each, and read them back.

    ids: n_rows x size little-endian, `width` bytes each; positions: likewise, 2 bytes each up to a size of 65,536, else 4. The
    cumulative lengths of row r are cu_seqlens[cu_offsets[r] : cu_offsets[r + 1]]. rows: what each row holds, and from where.
    """
    schema = MATRIX.format(segments=packed.schema["segments"].dataType.simpleString())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[pa.RecordBatch]] = {}

        def out(width: int, whole: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ends = whole.column("cu_seqlens").combine_chunks()
            offsets = ends.offsets.to_numpy()
            about = pa.StructArray.from_arrays([whole.column(c).combine_chunks() for c in ("grp", "row", "n_tokens", "segments")], names=["grp", "row", "n_tokens", "segments"])
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
            values = ends.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{number}"]), *(pa.array([x], pa.int32()) for x in (whole.num_rows, size, width)), pa.array([b"".join(whole.column("ids").to_pylist())], pa.binary()), pa.array([b"".join(whole.column("positions").to_pylist())], pa.binary()), one(values, None), one(offsets - offsets[0], pa.int32()), one(about, None)],
                names=["matrix", "n_rows", "size", "width", "ids", "positions", "cu_seqlens", "cu_offsets", "rows"],
            )

        for b in batches:
            widths = b.column(b.schema.get_field_index("width")).to_numpy()
            for w in np.unique(widths):
                waiting.setdefault(int(w), []).append(b.filter(pa.array(widths == w)))
                while sum(x.num_rows for x in waiting[int(w)]) >= rows:
                    whole = pa.Table.from_batches(waiting[int(w)])
                    yield out(int(w), whole.slice(0, rows).combine_chunks())
                    waiting[int(w)] = whole.slice(rows).to_batches()
        for w, left in waiting.items():
            if sum(x.num_rows for x in left):
                yield out(w, pa.Table.from_batches(left).combine_chunks())

    packed.mapInArrow(build, schema).write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(schema).parquet(path)


def packed_rows(matrices: DataFrame) -> DataFrame:
    """The packed rows (grp, row, n_tokens, width, ids, cu_seqlens, positions, segments) of written matrices."""
    n = matrices.select("*", F.posexplode("rows").alias("_r", "_about"))
    many = F.col("cu_offsets")
    part = lambda c, w: F.expr(f"substring({c}, cast(_r * size * {w} + 1 as int), cast(size * {w} as int))")
    wide = F.expr("cast(length(positions) / (n_rows * size) as int)")
    n = n.withColumn("_wide", wide)
    return n.select(
        "_about.grp", "_about.row", "_about.n_tokens", "width", part("ids", "width").alias("ids"),
        F.slice("cu_seqlens", F.element_at(many, F.col("_r") + 1) + 1, F.element_at(many, F.col("_r") + 2) - F.element_at(many, F.col("_r") + 1)).alias("cu_seqlens"),
        part("positions", "_wide").alias("positions"), "_about.segments",
    )
