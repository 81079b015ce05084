"""Review operators: slots, tasks, settlement of answers, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest


def slots(decisions: DataFrame, keys: Sequence[str], position: str, multiple: str) -> DataFrame:
    """(keys, slot, decisions): decision positions of each slot; a row of a multiple field is a slot of its own (slot = its position)."""
    slot = F.when(F.col(multiple), F.col(position))
    return decisions.groupBy(*keys, slot.alias("slot")).agg(F.array_sort(F.collect_list(position)).alias("decisions"))


def tasks(slot_rows: DataFrame, outcome: str, audited: Column) -> DataFrame:
    """Slots that need a person, with the mode of the task: review, missing, or audit for admitted slots that the sample picks."""
    mode = F.when(F.col(outcome).isNull(), "missing").when(F.col(outcome) == "needs_verification", "review").when((F.col(outcome) == "admitted") & audited, "audit")
    return slot_rows.withColumn("mode", mode).filter(F.col("mode").isNotNull())


def settle(answers: DataFrame, task: str, reviewer: str, order: Sequence[str], target: Column, agree: int = 1, unsure: Column | None = None, lead: Column | None = None) -> DataFrame:
    """(task, status): agreed, disputed or open, from each reviewer's latest answer; a lead's answer settles a dispute."""
    last = latest(answers, [task, reviewer], list(order))
    last = last.filter(~unsure) if unsure is not None else last
    last = last.withColumn("_t", target)
    leads = lead if lead is not None else F.lit(False)
    own = last.groupBy(task).agg(F.count("*").alias("_n"), F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.when(leads, 1)).alias("_leads"), F.min(F.when(leads, F.col("_t"))).alias("_la"), F.max(F.when(leads, F.col("_t"))).alias("_lb"))
    one = F.col("_a") == F.col("_b")
    by_lead = (F.col("_leads") > 0) & (F.col("_la") == F.col("_lb"))
    status = F.when(~one, F.when(by_lead, "agreed").otherwise("disputed")).when(F.col("_n") >= agree, "agreed").otherwise("open")
    return own.select(task, status.alias("status"))


def open_tasks(task_rows: DataFrame, settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without an answer that settles them."""
    return task_rows.join(settled.select(*keys).distinct(), list(keys), "left_anti")


def reviewer_pairs(answers: DataFrame, keys: Sequence[str], reviewer: str, answer: str) -> DataFrame:
    """(keys, first, second, same) of each pair of reviewers of a slot; slots have few reviewers."""
    a, b = answers.select(*keys, F.col(reviewer).alias("first"), F.col(answer).alias("_a")), answers.select(*keys, F.col(reviewer).alias("second"), F.col(answer).alias("_b"))
    return a.join(b, list(keys)).filter(F.col("first") < F.col("second")).select(*keys, "first", "second", (F.col("_a") == F.col("_b")).alias("same"))


def page(rows: DataFrame, keys: Sequence[str], after: tuple | None, size: int) -> DataFrame:
    """The next rows of a list in order of the keys, nulls first, after a key (keyset paging)."""
    if after is not None:
        later = F.lit(False)
        for i in reversed(range(len(keys))):
            k, v = F.col(keys[i]), F.lit(after[i])
            beyond = F.coalesce(k > v, F.lit(False)) if after[i] is not None else k.isNotNull()
            later = beyond | (k.eqNullSafe(v) & later)
        rows = rows.filter(later)
    return rows.orderBy(*(F.asc_nulls_first(k) for k in keys)).limit(size)


def escapes(settled: DataFrame, admitted: DataFrame, keys: Sequence[str], value: str, truth: str) -> DataFrame:
    """Audited slots, and those whose settled value differs from the admitted one."""
    both = settled.join(admitted, list(keys))
    return both.agg(F.count("*").alias("audited"), F.sum((~F.col(value).eqNullSafe(F.col(truth))).cast("long")).alias("escapes"))


# ---------------------------------------------------------------- fixed values
CORRECTIONS = ("correct", "adjust_span")
VERDICTS = ("confirm", "choose", "not_in_document", "unsure", "wrong", *CORRECTIONS)
CLOSED_SET_VERDICTS = ("confirm", "choose", "not_in_document", "unsure")
# ------------------------------------------------------------------------------


def item_kind(kind: Column, closed: Column, long: Column) -> Column:
    """What a task asks about: number, closed_set, span (a choice has a long citation) or text."""
    return F.when(F.coalesce(kind.isin("number", "integer"), F.lit(False)), "number").when(F.coalesce(closed, F.lit(False)), "closed_set").when(F.coalesce(long, F.lit(False)), "span").otherwise("text")


def check_answers(answers: DataFrame, task_rows: DataFrame) -> DataFrame:
    """The answers with `fault` (null: well-formed) and `counts`: a log counts up to its first answer with a fault.

    answers: (reviewer, sequence, task, verdict, decision, candidate, keys, ms, ...). task_rows: (task, item, choices array<int>), one row a
    task. Logs are cut by one least value a reviewer, which is taken before the shuffle; a null sequence cannot be ordered and is a fault of
    the whole log.
    """
    asked = task_rows.select("task", F.lit(True).alias("_known"), F.col("item").alias("_item"), F.col("choices").alias("_choices"))
    rows = answers.join(asked, "task", "left")
    no = F.lit(False)
    verdict, decision = F.col("verdict"), F.col("decision")
    typed = F.coalesce(verdict.isin(*CORRECTIONS), no)
    chosen = F.coalesce(verdict == "choose", no)
    whole = F.coalesce((F.col("keys") >= 0) & (F.col("ms") >= 0), no)
    fault = (
        F.when(F.col("sequence").isNull(), "sequence")
        .when(F.col("_known").isNull(), "task")
        .when(~F.coalesce(verdict.isin(*VERDICTS), no), "verdict")
        .when(~whole, "counts")
        .when((F.col("_item") == "closed_set") & ~verdict.isin(*CLOSED_SET_VERDICTS), "closed_set")
        .when(chosen & ~F.coalesce(F.array_contains("_choices", decision), no), "decision")
        .when(~chosen & decision.isNotNull(), "decision")
        .when(typed != F.col("candidate").isNotNull(), "candidate")
        .when((verdict == "confirm") & ~F.coalesce(F.size("_choices") == 1, no), "confirm")
    )
    rows = rows.withColumn("fault", fault).drop("_known", "_item", "_choices")
    first = rows.filter(F.col("fault").isNotNull()).groupBy(F.col("reviewer").alias("_who")).agg(F.min(F.coalesce("sequence", F.lit(-(1 << 63)))).alias("_stop"))
    out = rows.join(first, F.col("reviewer").eqNullSafe(F.col("_who")), "left")
    return out.withColumn("counts", F.col("_stop").isNull() | F.coalesce(F.col("sequence") < F.col("_stop"), no)).drop("_who", "_stop")


def blind(task_rows: DataFrame) -> DataFrame:
    """(task, mode, item, field, choices): tasks as a reviewer sees them, without document, key of the store or index of a decision.

    task_rows: (task, mode, item, field, choices array<struct<decision, value>>). A choice has its number in the task; an audit shows no
    choices, and an audit of a closed set no task at all.
    """
    shown = F.transform("choices", lambda c, i: F.struct(i.alias("choice"), c["value"].alias("value")))
    audit = F.coalesce(F.col("mode") == "audit", F.lit(False))
    rows = task_rows.filter(~(audit & F.coalesce(F.col("item") == "closed_set", F.lit(False))))
    return rows.select("task", "mode", "item", "field", F.when(~audit, shown).alias("choices"))
