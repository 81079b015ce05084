"""Language of texts by a linear-chain conditional random field over their words.

Each word has a label, its language, so that code-switched text keeps its parts. Features of a word: character
n-grams of 1 to 4 with word boundaries (those at a boundary are its affixes), and membership in each language's
lexicon (its commonest words). Transitions are learned. Training maximises the likelihood of label sequences
that switch language between spans of a labelled sample, by forward-backward; prediction takes every word of a
text and gives each word's marginals, also by forward-backward. A text's language is the one with the largest
sum of marginals; its score is that sum's share.

The sample is bounded by a parameter (`per_language` documents of each language in expectation); lexicons and
weights come from it. Predictions read texts alone.

Defined results: `und` with score 0 for a null text, a text without letters, or if nothing could be learned.
Rows are kept one for one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep_rows, pieces

#: Words: runs of letters (any script).
LETTERS = re.compile(r"[^\W\d_]+")
DIM, ORDERS, LEXICON = 1 << 16, (1, 2, 3, 4), 400
CHUNK = 32


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of all words, flat, and where each word's begin."""
    joined = "\x02" + "\x02".join(words) + "\x02"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = c == 2
    word_at = np.cumsum(edge) - 1  # the word that begins at or holds a position
    ids, owner = [], []
    total = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        total = total[:m] * np.uint64(1_000_003) + c[n - 1 : n - 1 + m]
        # an n-gram may touch a boundary at its ends alone
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= edge[i : i + m]
        ok = ~inner & ~(edge[:m] & (n == 1)) & (word_at[:m] < len(words))
        if n == 2:
            ok &= ~(edge[:m] & edge[1 : 1 + m])
        at = np.flatnonzero(ok)
        h = total[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        ids.append((h >> np.uint64(48)).astype(np.int64) % DIM)
        owner.append(word_at[at])
    lex = np.fromiter((DIM + lexicon.get(w, -1) if w in lexicon else -1 for w in words), np.int64, len(words))
    at = np.flatnonzero(lex >= 0)
    ids.append(lex[at])
    owner.append(at)
    owner, ids = np.concatenate(owner), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    return ids[order], starts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # labels x labels
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)), np.float32)
        for s in range(0, len(words), 20_000):
            part = words[s : s + 20_000]
            ids, starts = features(part, self.lexicon)
            out[s : s + len(part)] = np.add.reduceat(self.weights[ids], starts, axis=0)
        return out


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of each word, of sequences that follow one another in emit, by forward-backward.

    Sequences are cut into chunks; products of transfer matrices carry messages between chunks, so that all
    chunks of all sequences advance together. The result is that of one long chain for each sequence.
    """
    k = emit.shape[1]
    n_chunks = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(n_chunks)])
    total = int(first[-1])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    of = np.repeat(np.arange(len(lengths)), n_chunks)
    rank = np.arange(total) - first[of]
    begin = starts[of] + rank * CHUNK
    size = np.minimum(CHUNK, starts[of + 1] - begin)
    e = np.ones((CHUNK, total, k))
    pos = begin[None, :] + np.arange(CHUNK)[:, None]
    live = np.arange(CHUNK)[:, None] < size[None, :]
    flat = np.exp(emit.astype(np.float64) - emit.max(1, keepdims=True))
    e[live] = flat[pos[live]]
    t = np.exp(transitions.astype(np.float64))
    # transfer matrix of each chunk: from the message that enters it to the one that leaves it
    moved = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for i in range(CHUNK):
        step = (moved.reshape(-1, k) @ t).reshape(total, k, k) * e[i][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        moved = np.where(live[i][:, None, None], step, moved)
    enter, leave = np.ones((total, k)) / k, np.ones((total, k)) / k
    longest = int(n_chunks.max(initial=0))
    order = np.argsort(-n_chunks, kind="stable")
    counts = n_chunks[order]
    for r in range(longest - 1):
        live_seq = order[: np.searchsorted(-counts, -(r + 1), side="left")]  # of over r + 1 chunks
        c = first[live_seq] + r
        m = np.einsum("ck,ckj->cj", enter[c], moved[c])
        enter[c + 1] = m / m.sum(1, keepdims=True)
    for r in range(longest - 1, 0, -1):
        live_seq = order[: np.searchsorted(-counts, -r, side="left")]
        c = first[live_seq] + r
        m = np.einsum("cjk,ck->cj", moved[c], leave[c])
        leave[c - 1] = m / m.sum(1, keepdims=True)
    alpha = np.empty((CHUNK, total, k))
    a = enter
    for i in range(CHUNK):
        a = (a @ t) * e[i]
        a /= a.sum(1, keepdims=True)
        alpha[i] = a
    out = np.empty((int(starts[-1]), k))
    b = leave
    for i in range(CHUNK - 1, -1, -1):
        g = alpha[i] * b
        rows = live[i]
        out[pos[i][rows]] = g[rows] / g[rows].sum(1, keepdims=True)
        nb = (b * e[i]) @ t.T
        nb /= nb.sum(1, keepdims=True)
        b = np.where(rows[:, None], nb, b)
    return out


def fit(sample: list[tuple[str, str]], seed: int = 7, epochs: int = 3, tokens: int = 240_000) -> Model | None:
    """Learn from (text, language) pairs. tokens: words of training sequences, at most."""
    by: dict[str, list[list[str]]] = {}
    for text, lang in sample:
        if w := LETTERS.findall(text.lower()):
            by.setdefault(lang, []).append(w)
    if not by:
        return None
    labels = sorted(by)
    k = len(labels)
    rng = np.random.default_rng(seed)
    lexicon: dict[str, int] = {}
    groups: dict[int, int] = {}
    members: dict[str, int] = {}
    for j, lang in enumerate(labels):
        count = Counter(w for doc in by[lang] for w in doc)
        for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            members[w] = members.get(w, 0) | (1 << j)
    for w in sorted(members):
        lexicon[w] = groups.setdefault(members[w], len(groups))
    weights, grads = np.zeros((DIM + len(groups), k), np.float32), np.full((DIM + len(groups), k), 1e-6, np.float32)
    trans, tgrads = np.zeros((k, k)), np.full((k, k), 1e-6)
    # spans of 3 to 40 words of one language follow each other, of any language
    words, gold, lengths = [], [], []
    while len(words) < tokens:
        n0 = len(words)
        for _ in range(int(rng.integers(1, 5))):
            j = int(rng.integers(k))
            doc = by[labels[j]][int(rng.integers(len(by[labels[j]])))]
            s = int(rng.integers(max(1, len(doc) - 3)))
            part = doc[s : s + int(rng.integers(3, 41))]
            words += part
            gold += [j] * len(part)
        lengths.append(len(words) - n0)
    ids: dict[str, int] = {}
    index = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    gold, lengths = np.array(gold), np.array(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat, at = features(list(ids), lexicon)
    ends = np.concatenate([at[1:], [len(flat)]])
    model = Model(labels, weights, trans, lexicon)
    batch = 128
    for epoch in range(epochs):
        rate = 0.15 / (1 + epoch)
        for s in rng.permutation(np.arange(0, len(lengths), batch)):
            seqs = np.arange(s, min(s + batch, len(lengths)))
            lo, hi = starts[seqs[0]], starts[seqs[-1] + 1]
            types, inverse = np.unique(index[lo:hi], return_inverse=True)
            sizes = ends[types] - at[types]
            f = flat[np.repeat(at[types] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            emit = np.add.reduceat(weights[f], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)[inverse]
            p = marginals(emit, lengths[seqs], trans)
            g = -p
            g[np.arange(hi - lo), gold[lo:hi]] += 1
            by_type = np.zeros((len(types), k))
            np.add.at(by_type, inverse, g)
            touched, back = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(back, np.repeat(by_type[:, j], sizes), len(touched)) for j in range(k)], 1)
            grad -= 1e-3 * weights[touched]
            grads[touched] += grad**2
            weights[touched] += rate * grad / np.sqrt(grads[touched])
            # expected transitions: from neighbours' marginals and the pair potentials
            inside = np.ones(hi - lo, bool)
            inside[starts[seqs] - lo] = False
            r = np.flatnonzero(inside)
            pair = p[r - 1][:, :, None] * np.exp(trans)[None] * p[r][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            tg = -pair.sum(0)
            np.add.at(tg, (gold[lo:hi][r - 1], gold[lo:hi][r]), 1)
            tgrads += tg**2
            trans += rate * tg / np.sqrt(tgrads)
    return model


def label_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; every word of every text is labelled."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    most = 200_000 * 16 // max(16, len(model.labels) ** 2)  # words at once: transfer matrices grow with the square of labels
    step: list[int] = []
    lengths: list[int] = []
    words: list[str] = []

    def label() -> None:
        ids: dict[str, int] = {}
        index = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        sizes = np.array(lengths)
        p = marginals(model.emissions(list(ids))[index], sizes, model.transitions)
        sums = np.add.reduceat(p, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        best = sums.argmax(1)
        for j, k, share in zip(step, best, sums[np.arange(len(step)), best] / sizes, strict=True):
            langs[j], scores[j] = model.labels[k], float(min(1.0, share))
        for x in (step, lengths, words):
            x.clear()

    for i, t in enumerate(texts):
        found = LETTERS.findall(t.lower()) if t else []
        if not found or not any(map(str.isalpha, t)):  # signs such as superscript digits are no letters
            continue
        if step and len(words) + len(found) > most:
            label()
        step.append(i)
        lengths.append(len(found))
        words += found
    if step:
        label()
    return langs, scores


def sample_languages(train: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """(text, lang) rows of a labelled table of those columns and `key`: about per_language rows of each language, chosen by a hash of key."""
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    u = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    rows = train.filter(u < share[F.col("lang")]).select("text", "lang").limit(4 * per_language * len(sizes)).collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, per_language: int = 300, seed: int = 7) -> Model | None:
    """A model from a bounded sample of documents whose crc32(id as text) mod folds is not 0 and whose language is given."""
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ((F.crc32(F.col("key").cast("binary")) % folds) != 0))
    return fit(sample_languages(train, per_language), seed)


def language_id(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, lang_pred, score), one for each input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            langs, scores = label_batch(sent.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is recognised with a score of at least `least`; columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: list[str | None]) -> list[bool]:
        return [a != "und" and s >= least for a, s in zip(*label_batch(sent.value, texts), strict=True)]

    return keep_rows(docs, text_col, known)
