"""Structured Streaming forms: continuous admission, origin dedup, the stateful audit pick, latest answers, chained appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.calibration import AuditPick
from ..operators.gate import decisions
from ..sources.store import Store


def admit_stream(packets: DataFrame, schema: dict[str, Any], policy: dict[str, Any] | None = None, **options: Any) -> DataFrame:
    """Decisions of arriving packets. The stage has no state, so that a batch that runs again gives the same rows."""
    return decisions(packets, schema, policy, **options)


def first_by_origin(events: DataFrame, *origin: str) -> DataFrame:
    """The first event of each origin; no watermark, as a copy may come at any time."""
    return events.dropDuplicates(list(origin))


def audit_pick_stream(log: DataFrame, profile: str, order: str, document: str, items: str, seed: str, minimum: int = 30, start: str = "0.1") -> DataFrame:
    """(profile, ord, document, reason) of picked documents; the state of a profile is its picked items so far.

    Rows of a batch run in their order; a row with an order that the profile has passed fails the query.
    """
    rows = log.select(F.col(profile).cast("string").alias("profile"), F.col(order).cast("long").alias("ord"), F.col(document).cast("string").alias("document"), F.col(items).cast("long").alias("items"))

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        picked, last = state.get if state.exists else (0, -1)
        pick = AuditPick(seed, key[0], minimum, start)
        pick.items = picked
        out = []
        for ord_, doc, n in pd.concat(list(batches)).sort_values("ord")[["ord", "document", "items"]].itertuples(index=False):
            if ord_ <= last:
                raise ValueError(f"row {ord_} of {key[0]} comes after row {last}")
            last = int(ord_)
            if reason := pick.offer(doc, int(n)):
                out.append((key[0], last, doc, reason))
        state.update((pick.items, last))
        yield pd.DataFrame(out, columns=["profile", "ord", "document", "reason"])

    return rows.groupBy("profile").applyInPandasWithState(run, "profile string, ord long, document string, reason string", "picked long, last long", "append", GroupStateTimeout.NoTimeout)


def latest_stream(answers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest answer of each key so far (update or complete mode)."""
    rest = [c for c in answers.columns if c not in {*keys, order}]
    return answers.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*")


def append_stream(events: DataFrame, store: Store, log: str, body: str, checkpoint: str, order: str) -> StreamingQuery:
    """Append arriving bodies to a hash-chained log. A batch that the log already holds, by its number, is not written again.

    The digests of a chain follow one another, so a micro-batch is one append made on the driver: bound it by the source's
    maxFilesPerTrigger or the like.
    """

    def write(batch: DataFrame, number: int) -> None:
        mark = f"batch:{number}"
        if not store.log(log).filter(F.col("body") == mark).isEmpty():
            return
        bodies = [r[0] for r in batch.orderBy(order).select(F.col(body).cast("string")).collect()]
        if bodies:
            store.append(log, [mark, *bodies])

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, then stop."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
