"""Similarity join of texts on sets of word n-grams: MinHash banding, then exact verification.

A text's words (lower case, runs of letters, digits and _) give its set of n-word shingles; a text of fewer words
is one shingle. Texts with equal sets are one node, so copies cost nothing further. MinHash signatures of the
nodes are cut into bands; bands and rows are chosen so that a pair at the threshold shares a band with
probability `recall` at least. Rows are shuffled on band hashes and pairs within a bucket are verified on the
full shingle sets.

Buckets of any size: in each bucket every node is first verified against one node of the bucket, its pivot, so
that a bucket costs as many pairs as it has nodes. A pair of nodes that links have connected, in this bucket or any
other, is decided. While the pairs left are more than `expand` times the rows of open buckets, further pivots are
taken, for `rounds` rounds at most; then every pair left is verified, a bucket being dealt out as a grid of blocks
of bounded size. So no candidate pair is dropped: it is connected by other links or verified.

Those links form the classes. Each link lies within a class, so n_links comes from a second pass, in which all pairs of
a class are verified in a grid of blocks; a class whose buckets hold fewer pairs than itself is verified by bucket.

Result: each row's class (the least id of its connected component of links), its copies, and n_links, the
number of other nodes within the threshold of its own (copies are no links).

Defined results: null, empty and wordless texts are alone in a class of their own id; ids that are null stay
null but their text takes part; repeated rows are copies and each get a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, WordIds, materialize, mixed, pieces, release, shingle_hashes, small_side


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, at most `most` hashes in all, find a pair at the threshold with the given probability; then as few bands as do."""
    best = None
    for rows in range(1, most + 1):
        bands = 1 if threshold >= 1 else max(1, int(np.ceil(min(most + 1, np.log1p(-recall) / np.log1p(-(threshold**rows))))))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"no bands within {most} hashes reach a recall of {recall} at {threshold}")
    return best


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ids, at, parts = WordIds(), [], []
    for t in texts:
        w = WORD.findall(t.lower()) if t else []
        parts.append(len(w))
        at.append(ids.of(w))
    if not texts:
        return []
    h = ids.hashes()
    return [np.unique(shingle_hashes(h[a], n)) for a in at]


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash signatures of nonempty sets, one row each."""
    rng = np.random.default_rng(20_240_501)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(sets), count), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (held < 30_000 or hi == lo):
            held += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo:hi]])[:-1]])
        tmp, top = np.empty_like(flat), np.empty(len(flat), np.uint32)
        for k in range(count):
            np.multiply(flat, a[k], out=tmp)
            tmp += b[k]
            np.right_shift(tmp, np.uint64(32), out=tmp)
            top[:] = tmp
            out[lo:hi, k] = np.minimum.reduceat(top, starts)
        lo = hi
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band and its number."""
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mixed(out * np.uint64(31) + sig[:, r::rows][:, :bands] + np.uint64(1))
    return mixed(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _nodes(rows: DataFrame, n: int, bands: int, per_band: int, kind: str) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), n)
            live = [i for i, x in enumerate(sets) if len(x)]
            hashes = band_hashes(signatures([sets[i] for i in live], bands * per_band), bands, per_band).view(np.int64) if live else []
            nodes: list[bytes | None] = [None] * len(sets)
            each: list[np.ndarray | None] = [None] * len(sets)
            for i, h in zip(live, hashes, strict=True):
                nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                each[i] = h
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(each, pa.list_(pa.int64())), b.column(1)], names=["id", "node", "bands", "text"])

    return materialize(rows.mapInArrow(sign, f"id {kind}, node binary, bands array<long>, text string"), "signed")


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, d): the Jaccard distance of each pair of nodes."""
    first, second = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, 2, 1 << 20):
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                seen: dict[str, int] = {}
                at = [[seen.setdefault(t, len(seen)) for t in b.column(c).to_pylist()] for c in (2, 3)]
                sets = shingle_sets(list(seen), n)
                d = [1 - jaccard(sets[i], sets[j]) for i, j in zip(*at, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], names=["a", "b", "d"])

    return materialize(joined.mapInArrow(compare, "a binary, b binary, d double"), "verified")


def _distances(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard distances of all pairs of sets."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), size)
    _, at, k = np.unique(flat, return_inverse=True, return_counts=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    shared = np.flatnonzero(k > 1)
    to = np.full(len(k), -1)
    to[shared] = np.arange(len(shared))
    col = to[at]
    for s in range(0, len(shared), 8_192):
        on = (col >= s) & (col < s + 8_192)
        m = np.zeros((len(sets), min(8_192, len(shared) - s)), np.float32)
        m[who[on], col[on] - s] = 1
        both += m @ m.T
    return 1 - both / (size[:, None] + size[None, :] - both)


#: Nodes and characters of a block in which pairs of a bucket are verified, or the links of a class are counted.
BLOCK, COUNT_BLOCK, BLOCK_CHARS = 512, 512, 4 << 20


def _in_blocks(state: DataFrame, texts: DataFrame, n: int, limit: float) -> DataFrame:
    """(a, b, d) within the limit, of all pairs of a bucket's nodes with different labels; state: (bucket, node, label, n).

    A bucket is a grid of blocks; each cell is verified by one task, on shingle sets. A pair is verified in the least bucket that it shares.
    """
    chars = materialize(state.join(texts.select("node", F.length("text").cast("long").alias("chars")), "node"), "sized")
    cells = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    grid = materialize(chars.groupBy("bucket").agg(cells.alias("cells")), "cells")
    rows = chars.drop("chars").join(small_side(grid), "bucket").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("cells")).cast("int"))
    rows = rows.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "bands", "text")
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def cell(key: tuple[int, int, int], part: list[dict]) -> list[tuple[bytes, bytes, float]]:
        bucket, lo, hi = key
        if len({r["label"] for r in part}) < 2:
            return []
        d = _distances(shingle_sets([r["text"] for r in part], n))
        block = np.array([r["own"] for r in part])
        fits = np.triu(d <= limit, 1) & ((block[:, None] != block[None, :]) if lo != hi else True)
        out = []
        for i, j in zip(*np.nonzero(fits), strict=True):
            x, y = part[i], part[j]
            if x["label"] != y["label"] and min(set(x["bands"]) & set(y["bands"])) == bucket:
                a, b = sorted((x["node"], y["node"]))
                out.append((a, b, float(d[i, j])))
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, []

        def out() -> pa.RecordBatch:
            found = cell(key, part) if len(part) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.float64())], names=["a", "b", "d"])

        for b in batches:
            for r in b.to_pylist():
                k = (r["bucket"], r["lo"], r["hi"])
                if k != key:
                    if part:
                        yield out()
                    key, part = k, []
                part.append(r)
        if part:
            yield out()

    return rows.mapInArrow(verify, "a binary, b binary, d double").distinct()


def link_counts(texts: DataFrame, roots: DataFrame, n: int, limit: float) -> DataFrame:
    """(node, n_links): the nodes within the limit of each node; texts: (node, text, bands), roots: (node, root) of components.

    A group is a component, or one of its buckets where these hold fewer pairs; then a pair is counted in the least bucket that it shares.
    """
    members = materialize(texts.join(roots, "node").select("node", "root", "bands", F.length("text").cast("long").alias("chars")), "classed")
    size = members.groupBy("root").agg(F.count("*").alias("n"))
    large = materialize(size.filter(F.col("n") > COUNT_BLOCK), "large")
    in_bands = members.join(small_side(large), "root").select("root", "n", "node", "chars", "bands", F.explode("bands").alias("bucket"))
    by_band = in_bands.groupBy("root", "n", "bucket").agg(F.count("*").alias("k"))
    split = by_band.groupBy("root", "n").agg(F.sum(F.col("k") * F.col("k")).alias("pairs")).filter(F.col("pairs") < F.col("n") * F.col("n"))
    split = materialize(split.select("root"), "split")
    parted = small_side(split)
    whole = members.join(parted, "root", "left_anti").select("root", F.lit(0).cast("long").alias("bucket"), "node", "chars", F.lit(None).cast("array<long>").alias("bands"))
    some = in_bands.join(parted, "root", "left_semi").select("root", "bucket", "node", "chars", "bands")
    groups = materialize(whole.unionByName(some), "groups")
    cells = F.greatest(F.lit(1), F.ceil(F.count("*") / COUNT_BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    grid = materialize(groups.groupBy("root", "bucket").agg(F.count("*").alias("n"), cells.alias("cells")).filter("n > 1").drop("n"), "grid")
    rows = groups.join(small_side(grid), ["root", "bucket"]).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("cells")).cast("int"))
    rows = rows.join(texts.select("node", "text"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.select("root", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "bands", "text")
    rows = rows.repartition("root", "bucket", "lo", "hi").sortWithinPartitions("root", "bucket", "lo", "hi")

    def cell(key: tuple[bytes, int, int, int], part: list[dict]) -> tuple[list[bytes], np.ndarray]:
        _, bucket, lo, hi = key
        sets = shingle_sets([r["text"] for r in part], n)
        own = np.array([r["own"] for r in part])
        fits = _distances(sets) <= limit
        np.fill_diagonal(fits, False)
        if lo != hi:
            fits &= own[:, None] != own[None, :]
        if part[0]["bands"] is not None:
            bands = np.array([r["bands"] for r in part])
            least = np.full(fits.shape, np.iinfo(np.int64).max)
            for x in bands.T:
                np.minimum(least, x[:, None], out=least, where=x[:, None] == x[None, :])
            fits &= least == bucket
        return [r["node"] for r in part], fits.sum(axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, []

        def out() -> pa.RecordBatch:
            nodes, found = cell(key, part) if len(part) > 1 else ([], np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.int64())], names=["node", "n_links"])

        for whole in batches:
            for s in range(0, whole.num_rows, 100):
                for r in whole.slice(s, 100).to_pylist():
                    k = (r["root"], r["bucket"], r["lo"], r["hi"])
                    if k != key:
                        if part:
                            yield out()
                        key, part = k, []
                    part.append(r)
        if part:
            yield out()

    counts = materialize(rows.mapInArrow(count, "node binary, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links")), "counts")
    release(members, large, split)
    release(groups, grid)
    return counts


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected links (a, b): root is the least node of its component.

    Labels fall to the least of a node's neighbours' labels, then to their labels' labels, until none changes.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = materialize(labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "m").alias("to")), "step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = materialize(step.join(jump, "to").select("node", F.least("to", "far").alias("root"), (F.least("to", "far") != F.col("root")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        release(step, labels)
        labels = new
        if not moved:
            release(edges)
            out = labels.select("node", "root")
            out._evidora_path = labels._evidora_path
            return out


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(signed, links): rows (id, node, bands, text) as many as docs has, and pairs (a, b, d) of nodes within the threshold, enough for the classes."""
    signed, links, texts = _linked(docs, id_col, text_col, **options)
    release(texts)
    return signed, links


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, expand: float = 4.0, rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """similarity_links() and the texts (node, text, bands) of all nodes that share a bucket."""
    bands, per_band = choose_bands(threshold, recall)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = _nodes(rows, n, bands, per_band, kind)
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands"))
    each = materialize(nodes.select("node", F.explode("bands").alias("bucket")), "buckets")
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    shared = materialize(shared, "shared")
    state = materialize(each.join(shared.select("bucket"), "bucket").select("bucket", "node", F.col("node").alias("label")), "members")
    wanted = state.select("node").distinct()
    n_wanted = wanted.count()
    texts = materialize(signed.select("node", "text", "bands").join(small_side(wanted, n_wanted), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"), F.first("bands").alias("bands")), "texts")
    limit = 1 - threshold + 1e-9
    known: DataFrame | None = None  # verified pairs, the lesser node first
    pivots = shared.select("bucket", "pivot", F.col("pivot").alias("to"))
    for turn in range(rounds):
        both = state.join(pivots, "bucket").filter(F.col("label") != F.col("to"))
        pairs = both.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        done = _verified(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), texts, n)
        known = done if known is None else known.unionByName(done)
        roots = components(known.filter(F.col("d") <= limit))
        moved = state.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
        moved = materialize(moved, "moved")
        # pairs left in a bucket: of nodes with different labels
        sizes = moved.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
        sizes = materialize(sizes.filter("same < n * n").select("bucket", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")), "sizes")
        total = sizes.agg(F.sum("pairs"), F.sum("n")).first()
        release(state)
        state = materialize(moved.join(sizes.select("bucket", "n"), "bucket"), "open")
        release(moved, sizes)
        if not total[0] or total[0] <= expand * total[1]:
            break
        chosen = F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("p")
        pivots = materialize(state.groupBy("bucket").agg(chosen).select("bucket", F.col("p.node").alias("pivot"), F.col("p.label").alias("to")), "pivots")
    more = _in_blocks(state, texts, n, limit)
    links = materialize(known.filter(F.col("d") <= limit).unionByName(more), "links")
    release(each, shared)
    release(state)
    return signed, links, texts


def _classes(signed: DataFrame, links: DataFrame, texts: DataFrame | None = None, n: int = 5, limit: float = 0.0) -> DataFrame:
    """(node, class_id, n_copies, n_links) of every node; n_links of all pairs within the limit if texts are given, else of the links given."""
    own = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n_copies"))
    found = components(links)
    if texts is None:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    else:
        degree = link_counts(texts, found, n, limit)
        release(texts)
    own = own.join(found, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = materialize(own, "own")
    least = own.groupBy("root").agg(F.min("least").alias("class_id"))
    return materialize(own.join(least, "root").select("node", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, **options) -> DataFrame:
    """Rows (id_col, class_id, n_copies, n_links), one for each input row. n_copies: rows with the same shingles, the row itself among them."""
    signed, links, texts = _linked(docs, id_col, text_col, threshold, n, **options)
    out = signed.select("id", "node").join(_classes(signed, links, texts, n, 1 - threshold + 1e-9), "node", "left")
    alone = F.col("node").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that are not the least id of their class; columns as they are.

    Rows without words and rows whose id is null stay. Of rows with equal id and text one stays.
    """
    signed, links = similarity_links(docs, id_col, text_col, **options)
    each = signed.select("id", "node", F.xxhash64("text").alias("digest")).join(_classes(signed, links), "node", "left")
    each = materialize(each.select("id", "digest", (F.col("node").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("class_id"))).alias("goes")), "goes")
    gone = each.filter("goes").select(F.col("id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    hit = (F.col(f"`{id_col}`") == F.col("_gone_id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("_gone_digest"))
    out = docs.join(small_side(gone), hit, "left_anti")
    twice = each.filter(~F.coalesce("goes", F.lit(False)) & F.col("id").isNotNull()).groupBy("id", "digest").count().filter("count > 1")
    if not twice.isEmpty():
        with_id = out.filter(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, text_col])
        out = with_id.unionByName(out.filter(F.col(f"`{id_col}`").isNull()))
    return out
