"""Finding benchmark items in training texts: BM25 over an inverted index of the items, block-max WAND, then overlap.

Items are indexed, documents are queries. An item's BM25 weights are divided by their sum, so that a passage with
all of an item's terms scores 1 and one threshold serves items of every length. A document is read in windows of W
words (at least as many as the longest item of the index); two neighbouring windows are a passage, so an item's copy
lies whole in some passage. Every term has its posting list, cut into blocks of items, and the greatest weight of each
block in which it occurs. For many passages at once the block maxima of their terms are added up; terms with long lists
and little weight are not walked but count with their greatest weight. Blocks below the threshold are skipped; where
some reach it, WAND walks the posting lists of the passage's terms, from one such block to the next, and scores the
items that can reach it. Each hit is verified: at least `question` of the n-grams of the item's question and `answer` of
those of its answer must stand in the passage. An item's question is its text up to the last question mark, if words
follow it, else its first two thirds of words; the answer is the rest.

An index is arrays, about 2 KB an item of 100 words. It holds at most SHARD items and SHARD_CHARS characters, so that
what is sent to the executors has a fixed size; further items go into further indexes, each one pass over the
documents. Document frequencies and the mean length are those of all items.

Defined results: null, empty or wordless texts match nothing; so do null items. An item without an answer (one word)
needs its question only. Repeated rows of documents are reported each; items with equal id and text count once. Ids
may be of any type that sorts.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ._shared import WORD, keep_rows, materialize, mixed, pieces

K1, B = 1.2, 0.75
SHARD, SHARD_CHARS, BLOCK, N = 100_000, 64 << 20, 2, 5
#: Lists of more blocks than this may go unwalked, up to a share of the threshold; cells and list entries in memory at once.
LONG, UNWALKED, CELLS, ENTRIES = 128, 0.25, 1 << 21, 1 << 21


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    cut = text.rfind("?")
    if cut >= 0 and WORD.search(text[cut:]) and WORD.search(text[:cut]):
        return words_of(text[: cut + 1]), words_of(text[cut + 1 :])
    w = words_of(text)
    k = -(-2 * len(w) // 3)
    return w[:k], w[k:]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of n term numbers."""
    if not n or len(ids) < n:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(ids, n))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n term numbers."""
    ids = ids.astype(np.int64).view(np.uint64)
    out = np.full(max(0, len(ids) - n + 1), n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(out) + i])
    return out


def _starts(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 and so on, `many` of each, one after the other."""
    return np.repeat(first - _starts(many)[:-1], many) + np.arange(int(many.sum()))


@dataclass
class Index:
    items: pa.Array  # ids
    terms: dict[str, int]
    at: np.ndarray  # of each term, where its postings begin
    who: np.ndarray  # item numbers, ascending in each term
    weight: np.ndarray
    block_at: np.ndarray  # of each term, where its blocks begin
    block: np.ndarray
    block_max: np.ndarray
    most: np.ndarray  # of each term
    grams_at: np.ndarray  # of each item, where the n-grams of its question begin, then those of its answer
    grams: np.ndarray
    sizes: np.ndarray  # of each item, words of an n-gram of its question and of its answer
    window: int

    @property
    def n_blocks(self) -> int:
        return -(-len(self.items) // BLOCK)

    @staticmethod
    def of(items: list[tuple[object, str]], df: dict[str, int], n_items: int, mean_length: float, kind: pa.DataType | None = None) -> Index:
        terms: dict[str, int] = {}
        flat: list[int] = []
        kept, parts, window = [], [], 64
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            flat += [terms.setdefault(t, len(terms)) for t in w]
            k = len(question_and_answer(text)[0])  # the answer is the words that follow
            parts += [k, len(w) - k]
            kept.append(item)
            window = max(window, len(w))
        flat, parts = np.array(flat, np.int64), np.array(parts, np.int64)
        length = parts.reshape(-1, 2).sum(1)
        item = np.repeat(np.arange(len(kept)), length)
        pairs, tf = np.unique(flat * max(1, len(kept)) + item, return_counts=True)  # by term, items ascending
        term, who = pairs // max(1, len(kept)), (pairs % max(1, len(kept))).astype(np.int32)
        each = np.array([df[t] for t in terms], np.float64)
        own = np.log(1 + (n_items - each + 0.5) / (each + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[who] / mean_length)) if len(term) else np.empty(0)
        weight = (own / np.bincount(who, own)[who] if len(term) else own).astype(np.float32)
        at = np.searchsorted(term, np.arange(len(terms) + 1))
        blocks = who // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])])) if len(term) else np.empty(0, np.int64)
        block_max = np.maximum.reduceat(weight, first) if len(first) else weight
        most = np.maximum.reduceat(weight, at[:-1]) if len(terms) else weight
        sizes, begins = np.minimum(N, parts), _starts(parts)[:-1]
        of, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for n in range(1, N + 1):
            mine = np.flatnonzero(sizes == n)
            many = parts[mine] - n + 1
            found.append(gram_hashes(flat, n)[_ranges(begins[mine], many)])
            of.append(np.repeat(mine, many))
        of, found = np.concatenate(of), np.concatenate(found)
        order = np.lexsort((found, of))
        of, found = of[order], found[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])[: len(of)]
        of, found = of[new], found[new]
        return Index(pa.array(kept, kind), terms, at, who, weight, np.searchsorted(first, at), blocks[first], block_max, most, np.searchsorted(of, np.arange(len(parts) + 1)), found, sizes.reshape(-1, 2), window)

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.who[self.at[t] : self.at[t + 1]], self.weight[self.at[t] : self.at[t + 1]]

    def _block_max(self, t: int, block: int) -> float:
        a, b = self.block_at[t], self.block_at[t + 1]
        i = a + int(np.searchsorted(self.block[a:b], block))
        return float(self.block_max[i]) if i < b and self.block[i] == block else 0.0

    def wand(self, query: list[int], threshold: float, live: list[int] | None = None) -> list[tuple[int, float]]:
        """Items that score at least threshold for a set of terms, with their scores. live: blocks, ascending, that can hold such an item."""
        found = []
        slack = threshold - 1e-6
        cursors = [[int(self.who[self.at[t]]), int(self.at[t]), t] for t in query]
        while cursors:
            # pivot: the first item that the lists up to it could lift to the threshold
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += float(self.most[c[2]])
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            following = 0 if live is None else bisect.bisect_left(live, block)
            if live is not None and following == len(live):
                break
            if live is not None and live[following] != block:
                to = live[following] * BLOCK  # on to the next block that can reach the threshold
            elif sum(self._block_max(c[2], block) for c in cursors[: pivot + 1]) < slack:
                # no item of this block can: on to the next block, or to the next list's item if that is nearer
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
            elif cursors[0][0] == item:
                score = sum(float(self.weight[c[1]]) for c in cursors[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            left = []
            for i, (at, pos, t) in enumerate(cursors):
                if i <= pivot and at < to:
                    end = int(self.at[t + 1])
                    pos += int(np.searchsorted(self.who[pos:end], to))
                    if pos == end:
                        continue
                    at = int(self.who[pos])
                left.append([at, pos, t])
            cursors = left
        return found


def search(index: Index, texts: list[str | None], threshold: float, question: float, answer: float) -> list[dict[int, tuple[float, float, float]]]:
    """For each text: item number -> (best score, overlap with the question, with the answer), of verified items."""
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    if not len(index.items):
        return out
    get = index.terms.get
    start = 0
    while start < len(texts):
        ids: list[int] = []
        lengths = []
        stop = start
        while stop < len(texts) and (len(ids) < 300_000 or stop == start):
            t = [get(x, -1) for x in words_of(texts[stop])]
            ids += t
            lengths.append(len(t))
            stop += 1
        _search(index, np.array(ids, np.int64), np.array(lengths), threshold, question, answer, out, start)
        start = stop
    return out


def _search(index: Index, ids: np.ndarray, lengths: np.ndarray, threshold: float, question: float, answer: float, out: list, offset: int) -> None:
    w = index.window
    windows = -(-lengths // w)
    first, starts = _starts(windows), _starts(lengths)
    total = int(first[-1])
    if not total:
        return
    doc = np.repeat(np.arange(len(lengths)), lengths)
    window = first[doc] + (np.arange(len(ids)) - starts[doc]) // w
    doc_of = np.repeat(np.arange(len(lengths)), windows)
    hit = np.flatnonzero(ids >= 0)
    m = len(index.terms)
    # the terms of each passage: those of a window, and of the next one of its document
    own = window[hit]
    second = hit[(own > 0) & (doc_of[own] == doc_of[own - 1])]
    pairs = np.unique(np.concatenate([own * m + ids[hit], (window[second] - 1) * m + ids[second]]))
    at, term = pairs // m, pairs % m
    bounds = np.searchsorted(at, np.arange(total + 1))
    many = index.block_at[term + 1] - index.block_at[term]
    rest = np.zeros(total)
    walked = np.ones(len(pairs), bool)
    long = np.flatnonzero(many > LONG)
    if len(long):  # the longest lists of each passage go unwalked while their weights are few
        order = long[np.lexsort((-many[long], at[long]))]
        most = index.most[term[order]].astype(np.float64)
        run = np.cumsum(most)
        begins = np.searchsorted(at[order], at[order])
        run -= run[begins] - most[begins]
        left_out = order[run <= UNWALKED * threshold]
        walked[left_out] = False
        np.add.at(rest, at[left_out], index.most[term[left_out]])
    cost = _starts(np.where(walked, many, 0))[bounds]  # list entries before each passage
    blocks, lo = index.n_blocks, 0
    while lo < total:
        hi = max(lo + 1, min(total, lo + max(1, CELLS // blocks), int(np.searchsorted(cost, cost[lo] + ENTRIES, side="right")) - 1))
        own = np.flatnonzero(walked[bounds[lo] : bounds[hi]]) + bounds[lo]
        entry = _ranges(index.block_at[term[own]], many[own])
        cell = np.repeat(at[own] - lo, many[own]) * blocks + index.block[entry]
        sums = np.bincount(cell, index.block_max[entry], (hi - lo) * blocks).reshape(hi - lo, blocks) + rest[lo:hi, None]
        passage, block = np.nonzero(sums >= threshold - 1e-4)
        for p in np.unique(passage):
            g = lo + int(p)
            d = int(doc_of[g])
            begin = starts[d] + (g - first[d]) * w
            got: dict[int, np.ndarray] = {}
            span = ids[begin : min(starts[d + 1], begin + 2 * w)]
            for item, score in index.wand(term[bounds[g] : bounds[g + 1]].tolist(), threshold, block[passage == p].tolist()):
                shares = []
                for k in (0, 1):
                    n = int(index.sizes[item, k])
                    have = got[n] if n in got else got.setdefault(n, grams(span, n))
                    want = index.grams[index.grams_at[2 * item + k] : index.grams_at[2 * item + k + 1]]
                    shares.append(float(np.isin(want, have, assume_unique=True).mean()) if len(want) else 1.0)
                if shares[0] >= question and shares[1] >= answer and score > out[offset + d].get(item, (-1.0,))[0]:
                    out[offset + d][item] = (score, *shares)
        lo = hi


def build_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes of all items, of at most SHARD items and SHARD_CHARS characters each; statistics are those of all items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull()).dropDuplicates()

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    word_rows = materialize(rows.select("id", "text", cut("text").alias("w")).filter(F.size("w") > 0), "items")
    stats = word_rows.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"), F.sum(F.length("text")).alias("chars")).first()
    if not stats["n"]:
        return []
    n = int(stats["n"])
    # shards are filled to three quarters on average, so that none is over the bound by much
    parts = max(-(-n * 4 // (SHARD * 3)) if n > SHARD else 1, -(-stats["chars"] * 4 // (SHARD_CHARS * 3)) if stats["chars"] > SHARD_CHARS else 1)
    each = word_rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(parts)).alias("part"), F.explode(F.array_distinct("w")).alias("term"))
    df = materialize(each.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts")), "frequencies")
    out = []
    for p in range(parts):
        own = word_rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).select("id", "text").toArrow()
        texts = sorted(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True), key=lambda x: (x[0] is not None, x))
        counts = df.filter(F.array_contains("parts", F.lit(p).cast("long"))).select("term", "df").toArrow()
        out.append(Index.of(texts, dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True)), n, float(stats["mean"]), own.schema.field(0).type))
    return out


def contamination(docs: DataFrame, shards: list[Index], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.25) -> DataFrame:
    """Rows (id_col, item_id, score, question_overlap, answer_overlap): a row for each document and item found in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = None
    for index in shards or [Index.of([], {}, 0, 1.0, pa.int64())]:
        item_kind = from_arrow_type(index.items.type).simpleString()
        sent = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1):
                hits = search(sent.value, b.column(1).to_pylist(), threshold, question, answer)
                flat = [(i, item, *x) for i, h in enumerate(hits) for item, x in sorted(h.items())]
                col = lambda k: [x[k] for x in flat]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(col(0), pa.int64())), sent.value.items.take(pa.array(col(1), pa.int64())), *(pa.array(col(k), pa.float64()) for k in (2, 3, 4))], names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(find, f"id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, shards: list[Index], text_col: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.25) -> DataFrame:
    """The rows of docs in whose text no item is found; columns as they are."""
    for index in shards:
        docs = keep_rows(docs, text_col, _clean(docs.sparkSession.sparkContext.broadcast(index), threshold, question, answer))
    return docs


def _clean(sent, threshold: float, question: float, answer: float):
    def clean(texts: list[str | None]) -> list[bool]:
        return [not h for h in search(sent.value, texts, threshold, question, answer)]

    return clean
