"""Scoring texts by a log-bilinear language model trained with noise-contrastive estimation.

Tokens: a text with A-Z in lower case, cut at space and U+0009-U+000D; then one end token (here the empty
byte string). A null text is an empty one. Training rows are those whose crc32(id as text) mod `folds` is not
0 (a null id counts as an empty text, so it is held out).

Units. The `n_top` commonest tokens are units of their own; every other token belongs to one of `n_suffix`
units by its last three bytes. The neural model predicts a unit from the two before it: the context vector is
c1*r[u1] + c2*r[u2], the score of a unit w is its product with q[w] plus a bias. As the score is a sum over both
context positions, the normalisers of all contexts are one product of two matrices of exponentials, so token
probabilities are exactly normalised.

Training by noise-contrastive estimation uses every training token once. A hash of id and text deals texts out to
shards of about SHARD_TOKENS tokens (of more where there would be over MOST_SHARDS shards) and to ROUNDS rounds. In a
round each shard trains, as one task, from the same parameters; their means, weighted by tokens, begin the next round,
and so do those of the sums that scale the steps. The shards depend on the corpus alone, so results do not on files or
tasks. Texts are cut twice, to count tokens and to write their units; training and scoring read the units.

Within a unit a known token has its relative frequency, discounted by the unit's Good-Turing mass for
unseen tokens, which is shared as one event by all tokens that training has not seen.

Counts of the `n_frequent` commonest tokens travel to the executors as one table of bounded size; occurrences
of all others are joined with the table of counts, which has the size of the vocabulary.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, mixed, pieces

END = b""
DIM, NOISE, BATCH, RATE = 24, 32, 1024, 0.3
SHARD_TOKENS, MOST_SHARDS, ROUNDS = 2_000_000, 4_096, 4
FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


def suffix_unit(token: bytes, n_suffix: int) -> int:
    return zlib.crc32(token[-3:]) % n_suffix


class Units(dict):
    """Token to unit; tokens outside the commonest go by their suffix."""

    def __init__(self, top: list[bytes], n_suffix: int) -> None:
        super().__init__({t: i for i, t in enumerate(top)})
        self.first, self.n_suffix = len(top), n_suffix

    def __missing__(self, token: bytes) -> int:
        return self.first + zlib.crc32(token[-3:]) % self.n_suffix

    @property
    def size(self) -> int:
        return self.first + self.n_suffix


@dataclass
class Net:
    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray  # 2 x DIM

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c]

    def rows(self) -> np.ndarray:
        """All parameters, one row a unit and one for the context weights."""
        return to_rows(self.parts())

    @staticmethod
    def of_rows(m: np.ndarray) -> Net:
        return Net(*of_rows(m))


def to_rows(parts: list[np.ndarray]) -> np.ndarray:
    r, q, b, c = parts
    return np.concatenate([np.concatenate([r, q, b[:, None]], 1), np.concatenate([c.reshape(1, -1), [[0]]], 1)])


def of_rows(m: np.ndarray) -> list[np.ndarray]:
    m = m.astype(np.float32)
    return [m[:-1, :DIM].copy(), m[:-1, DIM : 2 * DIM].copy(), m[:-1, -1].copy(), m[-1, : 2 * DIM].reshape(2, DIM).copy()]


def start_net(unit_counts: np.ndarray, seed: int = 3) -> Net:
    rng = np.random.default_rng(seed)
    n = len(unit_counts)
    p = (unit_counts + 0.5) / (unit_counts.sum() + 0.5 * n)
    return Net(rng.normal(0, 0.3, (n, DIM)).astype(np.float32), rng.normal(0, 0.05, (n, DIM)).astype(np.float32), np.log(p).astype(np.float32), np.ones((2, DIM), np.float32))


class Trainer:
    """Noise-contrastive estimation with steps scaled by AdaGrad."""

    def __init__(self, net: Net, unit_counts: np.ndarray, seed: int) -> None:
        self.net, self.rng = net, np.random.default_rng(seed)
        p = (unit_counts + 0.5) / (unit_counts.sum() + 0.5 * len(unit_counts))
        self.cum, self.log_kp = np.cumsum(p), np.log(NOISE * p).astype(np.float32)
        self.seen = [np.full(a.shape, 0.5, np.float32) for a in net.parts()]

    @staticmethod
    def _by_row(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows, kind="stable")
        s = rows[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[cut], np.add.reduceat(grad[order], cut, axis=0)

    def _step(self, which: int, a: np.ndarray, rows, grad: np.ndarray) -> None:
        acc = self.seen[which]
        acc[rows] += grad * grad
        a[rows] += RATE * grad / np.sqrt(acc[rows])

    def train(self, u1: np.ndarray, u2: np.ndarray, w: np.ndarray) -> None:
        n = self.net
        for s in range(0, len(w), BATCH):
            a, b, y = u1[s : s + BATCH], u2[s : s + BATCH], w[s : s + BATCH]
            noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
            ra, rb = n.r[a], n.r[b]
            h = n.c[0] * ra + n.c[1] * rb
            qy, qn = n.q[y], n.q[noise]
            good = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qy) + n.b[y] - self.log_kp[y], -30, 30)))
            bad = -1 / (1 + np.exp(-np.clip(h @ qn.T + n.b[noise] - self.log_kp[noise], -30, 30)))
            dh = good[:, None] * qy + bad @ qn
            scale = 1 / math.sqrt(len(y))
            rows, grad = self._by_row(np.concatenate([y, noise]), np.concatenate([np.concatenate([good[:, None] * h, good[:, None]], 1), np.concatenate([bad.T @ h, bad.sum(0)[:, None]], 1)]))
            self._step(1, n.q, rows, grad[:, :-1] * scale)
            self._step(2, n.b, rows, grad[:, -1] * scale)
            rows, grad = self._by_row(np.concatenate([a, b]), np.concatenate([n.c[0] * dh, n.c[1] * dh]))
            self._step(0, n.r, rows, grad * scale)
            self._step(3, n.c, slice(None), np.stack([(ra * dh).sum(0), (rb * dh).sum(0)]) * scale / 32)


def contexts(units: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two before each token of texts that follow one another; the end unit before a text begins."""
    one, two = np.empty_like(units), np.empty_like(units)
    one[1:], two[2:] = units[:-1], units[:-2]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    one[starts] = end
    two[starts] = end
    later = starts[lengths > 1] + 1
    two[later] = end
    return one, two


@dataclass
class Tables:
    """Log10 probabilities of units: first[u1, w] + second[u2, w] - norm[u1, u2]."""

    first: np.ndarray
    second: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(net: Net) -> Tables:
        a = ((net.c[0] * net.r) @ net.q.T + net.b).astype(np.float64)
        b = ((net.c[1] * net.r) @ net.q.T).astype(np.float64)
        ma, mb = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.exp(a - ma) @ np.exp(b - mb).T) + ma + mb.T
        k = math.log(10)
        return Tables((a / k).astype(np.float32), (b / k).astype(np.float32), (z / k).astype(np.float32))

    def log10(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.first[one, w].astype(np.float64) + self.second[two, w] - self.norm[one, two]


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token, c) of the training rows of (id, text, held_out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])
            found.clear()
            return b

        for b in pieces(batches, 0):
            for t in b.column(0).to_pylist():
                found.update(tokens(t))
                found[END] += 1
                if len(found) > FLUSH:
                    yield out()
        yield out()

    return rows.filter(~F.col("held_out")).select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The `most` commonest tokens, by count and token."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least, found = 0, None, []
    for at, n in levels:
        if held + n > most:  # of the level at which there are too many, the first ones
            found = counts.filter(level == at).orderBy(F.desc("c"), "token").limit(most - held).collect()
            break
        held, least = held + n, at
    if least is not None:
        found += counts.filter(level >= least).collect()
    return sorted(((bytes(r["token"]), int(r["c"])) for r in found), key=lambda x: (-x[1], x[0]))


def train_round(coded: DataFrame, number: int, shards: int, unit_counts: np.ndarray, end: int, net: Net, seen: np.ndarray) -> tuple[Net, np.ndarray]:
    """A round over rows (shard, round, place, units): every shard trains from `net`; the means of what they come to, weighted by tokens."""
    sent = coded.sparkSession.sparkContext.broadcast((unit_counts, net.rows().astype(np.float32), seen.astype(np.float32)))
    width = 2 * DIM + 1

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, start, scale = sent.value
        trainer, trained = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if trainer is None:
                trainer = Trainer(Net.of_rows(start), counts, number * MOST_SHARDS + b.column(0)[0].as_py())
                trainer.seen = of_rows(scale)
            texts = [np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()]
            lengths = np.array([len(x) for x in texts])
            u = np.concatenate(texts).astype(np.int64)
            trainer.train(*contexts(u, lengths, end), u)
            trained += len(u)
        if trained:
            m = np.concatenate([trainer.net.rows(), to_rows(trainer.seen)], 1).astype(np.float32)
            cut = range(0, len(m), 32)
            yield pa.RecordBatch.from_arrays([pa.array([i // 32 for i in cut], pa.int32()), pa.array([float(trained)] * len(cut)), pa.array([m[i : i + 32].tobytes() for i in cut], pa.binary())], names=["part", "weight", "values"])

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total, weight = 0.0, rows["weight"].sum()
        order = rows.sort_values(["weight", "values"])  # sums in one order whatever the tasks
        for w, v in zip(order["weight"], order["values"], strict=True):
            total = total + np.frombuffer(v, np.float32).astype(np.float64) * w
        return pd.DataFrame({"part": [key[0]], "values": [(total / weight).tobytes()]})

    own = coded.filter((F.col("round") == number) & ~F.col("held_out")).select("shard", "units", "place")
    dealt = own.repartitionById(shards, "shard").sortWithinPartitions("place", "units")
    out = dealt.select("shard", "units").mapInArrow(train, "part int, weight double, values binary").groupBy("part").applyInPandas(mean, "part int, values binary")
    parts = sorted((r["part"], bytes(r["values"])) for r in out.collect())  # as large as the model, whatever the input
    if not parts:
        return net, seen
    m = np.concatenate([np.frombuffer(v, np.float64).reshape(-1, 2 * width) for _, v in parts])
    return Net.of_rows(m[:, :width]), m[:, width:]


def lm_scoring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, n_top: int = 768, n_suffix: int = 256, n_frequent: int = 200_000) -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, unigram_score, score), one for each input row.

    base_score: sum over tokens of log10((c+0.1)/(N+0.1*(V+1))) of their training counts c. unigram_score: that of the model
    without its context, with each unit's share of the training tokens and the same smoothing within units. An empty
    table gives an empty result; without training rows N and V are 0 and all tokens are unseen.
    """
    if n_top + n_suffix > 1 << 16:
        raise ValueError("units are written in 16 bits")
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), ((F.crc32(key.cast("binary")) % folds) == 0).alias("held_out"))
    rows = rows.withColumn("place", F.xxhash64("id", "text"))
    counts = materialize(count_tokens(rows), "counts")
    n_first = F.lit(n_suffix)
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, n_kinds = int(total[0] or 0), int(total[1])
    frequent = commonest(counts, n_frequent)
    top = [t for t, _ in frequent[:n_top]]
    if END not in top:
        top = [END, *top[: n_top - 1]]
    # of each suffix unit: tokens in all, kinds seen once
    tail = counts.filter(~F.col("token").isin(top)) if len(top) < 64 else counts.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in top], "token binary")), "token", "left_anti")
    by_suffix = tail.groupBy((F.crc32(F.expr("substring(token, greatest(length(token) - 2, 1), 3)")) % n_first).cast("int").alias("g")).agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    mass, once = np.zeros(n_suffix), np.zeros(n_suffix)
    for r in by_suffix:
        mass[r["g"]], once[r["g"]] = r["n"], r["once"]
    known = dict(frequent)
    unit_counts = np.concatenate([[known.get(t, 0) for t in top], mass]).astype(np.float64)
    unseen = np.where(mass > 0, (once + 0.5) / (mass + 1), 1.0)
    below = math.log10(n_all + 0.1 * (n_kinds + 1))
    with np.errstate(divide="ignore"):
        # of a known token in a suffix unit: log10 of (1 - unseen) / mass, to which log10 c is added
        share = np.where(mass > 0, np.log10(np.maximum(1 - unseen, 1e-12)) - np.log10(np.maximum(mass, 1)), 0.0)
        new = np.log10(unseen)
    shards = max(1, min(MOST_SHARDS, -(-n_all // SHARD_TOKENS)))
    frequent_tokens = [t for t, _ in frequent]
    words_sent = spark.sparkContext.broadcast((frequent_tokens, np.array([c for _, c in frequent], np.float64), top, n_suffix, share))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, top, n_suffix, share = words_sent.value
        of = Units(top, n_suffix)

        class Index(dict):
            def __missing__(self, token: bytes) -> int:
                return -1 - of[token]

        index = Index((t, i) for i, t in enumerate(names))
        if END not in index:  # nothing to learn from
            index[END] = len(names)
            names, c = [*names, END], np.append(c, 0.0)
        unit = np.array([of[t] for t in names], np.int64)
        base = np.log10(c + 0.1) - below
        inner = np.zeros(len(names))
        tail = unit >= of.first
        inner[tail] = np.log10(c[tail]) + share[unit[tail] - of.first]
        seen = c > 0
        begin, row = os.urandom(8), 0
        for b in pieces(batches, 1):
            texts = b.column(1).to_pylist()
            words: list[bytes] = []
            lengths = []
            for t in texts:
                w = tokens(t)
                words += w
                words.append(END)
                lengths.append(len(w) + 1)
            if not lengths:
                continue
            lengths = np.array(lengths)
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            rare = at < 0
            u = np.where(rare, -1 - at, unit[np.where(rare, 0, at)])
            inside = np.where(rare, 0.0, inner[np.where(rare, 0, at)])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            fixed = np.where(rare, 0.0, base[np.where(rare, 0, at)])
            ok = np.where(rare, False, seen[np.where(rare, 0, at)])
            others: list[list[tuple[bytes, int]] | None] = [None] * len(texts)
            where = np.flatnonzero(rare)
            bounds = np.searchsorted(where, np.append(starts, len(words)))
            for i in np.flatnonzero(np.diff(bounds)):
                others[i] = list(Counter(words[j] for j in where[bounds[i] : bounds[i + 1]]).items())
            ids = [begin + (row + i).to_bytes(8, "big") for i in range(len(texts))]
            row += len(texts)
            u = u.astype(np.uint16)
            units = [u[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
            # repeated rows of a batch go to different shards
            again: Counter = Counter()
            place = b.column(3).to_numpy().copy()
            for i, p in enumerate(place.tolist()):
                if again[p]:
                    place[i] = zlib.crc32(f"{p} {again[p]}".encode()) - (1 << 31)
                again[p] += 1
            dealt = mixed(place.view(np.uint64))
            kind = pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(ok.astype(np.int64), starts)), pa.array(np.add.reduceat(fixed, starts)), pa.array(np.add.reduceat(inside, starts)), pa.array([None if o is None else [{"token": t, "k": k} for t, k in o] for o in others], kind),
                 pa.array(units, pa.binary()), pa.array(place), pa.array((dealt >> np.uint64(32)) % np.uint64(shards), pa.int32()), pa.array((dealt & np.uint64(0xFFFF)) % np.uint64(ROUNDS), pa.int32())],
                names=["id", "held_out", "row", "n_tokens", "n_known", "base_score", "inside", "others", "units", "place", "shard", "round"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.select("id", "text", "held_out", "place").mapInArrow(code, f"id {kind}, held_out boolean, row binary, n_tokens long, n_known long, base_score double, inside double, others array<struct<token:binary,k:bigint>>, units binary, place long, shard int, round int")
    coded = materialize(coded, "coded")
    end = Units(top, n_suffix)[END]
    net = start_net(unit_counts)
    seen = to_rows([np.full(a.shape, 0.5, np.float32) for a in net.parts()])
    for number in range(ROUNDS if n_all else 0):
        net, seen = train_round(coded, number, shards, unit_counts, end, net, seen)
    model_sent = spark.sparkContext.broadcast((Tables.of(net), np.log10((unit_counts + 0.5) / (unit_counts.sum() + 0.5 * len(unit_counts)))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, alone = model_sent.value
        names = ["id", "held_out", "row", "n_tokens", "n_known", "base_score", "unigram_score", "score"]
        for b in pieces(batches, 7, 2 << 20):
            if not b.num_rows:
                continue
            u = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint16).astype(np.int64)
            lengths = b.column(3).to_numpy()
            one, two = contexts(u, lengths, end)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            inside = b.column(6).to_numpy()
            sums = [np.add.reduceat(x, starts) + inside for x in (alone[u], tables.log10(one, two, u))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), *map(pa.array, sums)], names=names)

    scored = coded.select("id", "held_out", "row", "n_tokens", "n_known", "base_score", "inside", "units").mapInArrow(score, f"id {kind}, held_out boolean, row binary, n_tokens long, n_known long, base_score double, unigram_score double, score double")
    # tokens outside the bounded table: one row for each text and token, joined with the counts
    token_unit = (F.crc32(F.expr("substring(token, greatest(length(token) - 2, 1), 3)")) % n_first).cast("int")
    shares, news = F.array(*(F.lit(float(x)) for x in share)), F.array(*(F.lit(float(x)) for x in new))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = coded.select("row", F.inline("others")).join(counts, "token", "left")
    rest = rest.select(
        "row",
        (F.col("k") * (c > 0).cast("long")).alias("known"),
        (F.col("k") * (F.log10(c + 0.1) - below)).alias("base"),
        (F.col("k") * F.when(c > 0, F.log10(F.greatest(c, F.lit(1))) + shares[token_unit]).otherwise(news[token_unit])).alias("lp"),
    )
    rest = rest.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    out = scored.join(rest, "row", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + zero("base")).alias("base_score"), (F.col("unigram_score") + zero("lp")).alias("unigram_score"), (F.col("score") + zero("lp")).alias("score"))
