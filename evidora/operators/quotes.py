"""Exact quotes in texts: an Aho-Corasick pass over each text for all quotes of a bounded block at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quotes that travel to the executors together.
BLOCK = 20_000


def quote_hits(docs: DataFrame, quotes: DataFrame, quote_id: str, quote: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, quote_id, n): quotes that stand in a text, and how often without overlaps.

    Quotes are taken in blocks of a fixed number, each one pass over the texts; empty quotes stand nowhere.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    q = quotes.select(F.col(quote_id).cast("long").alias("qid"), F.col(quote).alias("q")).filter(F.length("q") > 0).distinct()
    blocks = max(1, -(-q.count() // (BLOCK * 3 // 4)))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for i in range(blocks):
        own: dict[str, list[int]] = {}
        for r in q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect():
            own.setdefault(r["q"], []).append(r["qid"])
        part = rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(own)), f"id {kind}, qid long, n long")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("qid").alias(quote_id), "n")


def _finder(sent):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for q in sent.value:
            machine.add_word(q, q)
        if sent.value:
            machine.make_automaton()
        for b in batches:
            at, who, n = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or not sent.value:
                    continue
                found: Counter[str] = Counter()
                free: dict[str, int] = {}
                for end, q in machine.iter(t):
                    if end - len(q) + 1 >= free.get(q, 0):
                        found[q] += 1
                        free[q] = end + 1
                for q, k in found.items():
                    for qid in sent.value[q]:
                        at.append(i)
                        who.append(qid)
                        n.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(who, pa.int64()), pa.array(n, pa.int64())], names=["id", "qid", "n"])

    return find
