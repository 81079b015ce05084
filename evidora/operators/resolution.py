"""Resolution of reviews: from decisions to slots and tasks, from answers to settled slots, and exports of both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import picked_at
from .windows import latest

SLOT = ("doc_id", "field", "key", "slot")


def slots_of(rows: DataFrame, multiple: Sequence[str]) -> DataFrame:
    """Slots of decisions: (doc_id, field, key, slot, decisions, mode, value). A slot with one live decision that is admitted has the mode audit, with none live it is rejected, else review."""
    marked = rows.withColumn("_multiple", F.col("field").isin(list(multiple)) if multiple else F.lit(False))
    live = F.col("outcome") != "rejected"
    slot = F.when(F.col("_multiple"), F.col("pos"))
    state = [F.sum(live.cast("int")).alias("_live"), F.sum((F.col("outcome") == "admitted").cast("int")).alias("_admitted"), F.max(F.when(F.col("outcome") == "admitted", F.col("value"))).alias("value")]
    own = marked.groupBy("doc_id", "field", "key", slot.alias("slot")).agg(F.array_sort(F.collect_list("pos")).alias("decisions"), *state)
    mode = F.when(F.col("_live") == 0, "rejected").when((F.col("_live") == 1) & (F.col("_admitted") == 1), "audit").otherwise("review")
    return own.select(*SLOT, "decisions", mode.alias("mode"), F.when(mode == "audit", F.col("value")).alias("value"))


def tasks_of(slot_rows: DataFrame, missing: DataFrame, audit_rate: str = "0.1", seed: str = "") -> DataFrame:
    """Tasks: review slots, required fields without a value, and admitted slots that the audit sample picks."""
    name = F.concat_ws(":", F.lit(seed), "doc_id", "field", F.coalesce("key", F.lit("")), F.coalesce(F.col("slot").cast("string"), F.lit("")))
    shown = slot_rows.filter((F.col("mode") == "review") | ((F.col("mode") == "audit") & picked_at(name, audit_rate)))
    absent = missing.select("doc_id", "field", F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("slot"), F.array().cast("array<int>").alias("decisions"), F.lit("missing").alias("mode"), F.lit(None).cast("string").alias("value"))
    out = shown.unionByName(absent)
    return out.withColumn("task", F.sha2(F.concat_ws(":", "doc_id", "field", F.coalesce("key", F.lit("")), F.coalesce(F.col("slot").cast("string"), F.lit(""))), 256))


def resolve(task_rows: DataFrame, answers: DataFrame, agree: int = 1, lead: Column | None = None) -> DataFrame:
    """(task..., status, settled): each task with the status of its answers.

    answers: (task, reviewer, sequence, verdict, target). The latest answer of a reviewer counts; `unsure` counts as none; `wrong` settles nothing.
    Two answers agree that have the same verdict and target. `agree` reviewers settle a slot if none disagrees; a lead settles a dispute.
    An audit that confirms keeps a slot admitted; another answer takes the admitted value away.
    """
    last = latest(answers, ["task", "reviewer"], ["sequence"]).filter(F.col("verdict") != "unsure")
    says = last.filter(F.col("verdict") != "wrong").withColumn("_t", F.struct("verdict", "target"))
    leads = lead if lead is not None else F.lit(False)
    own = says.groupBy("task").agg(F.count("*").alias("_n"), F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.min(F.when(leads, F.col("_t"))).alias("_la"), F.max(F.when(leads, F.col("_t"))).alias("_lb"))
    wrong = last.groupBy("task").agg(F.bool_or(F.col("verdict") == "wrong").alias("_wrong"))
    out = task_rows.join(own, "task", "left").join(wrong, "task", "left")
    one = F.coalesce(F.col("_a").eqNullSafe(F.col("_b")), F.lit(True))
    by_lead = F.col("_la").isNotNull() & F.col("_la").eqNullSafe(F.col("_lb"))
    told = F.when(by_lead & ~one, F.col("_la")).otherwise(F.col("_a"))
    enough = (F.col("_n") >= agree) & (one | by_lead)
    word = F.when(told["verdict"] == "confirm", "confirmed").when(told["verdict"] == "choose", "chosen").when(told["verdict"] == "not_in_document", "not_in_document").otherwise("corrected")
    audit = F.col("mode") == "audit"
    quiet = F.col("_n").isNull() & ~F.coalesce(F.col("_wrong"), F.lit(False))
    status = F.when(audit & (quiet | (enough & (told["verdict"] == "confirm"))), "admitted").when(F.col("_n").isNull(), "open").when(~one & ~by_lead, "disputed").when(enough, word).otherwise("open")
    settled = F.when(status == "admitted", F.col("value")).when(status.isin("chosen", "corrected", "confirmed"), F.coalesce(told["target"], F.col("value")))
    return out.withColumns({"status": status, "settled": settled}).drop("_n", "_a", "_b", "_la", "_lb", "_wrong")


def corrected(rows: DataFrame, corrections: DataFrame, packets: DataFrame, admit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decisions of packets in which a person's candidate takes the place of a slot's candidates.

    corrections: (doc_id, field, key, candidate). The packet keeps its other candidates, so that relations check the new value.
    """
    slot = rows.select("doc_id", "pos", "field", "key")
    fix = corrections.select("doc_id", F.col("field").alias("_f"), F.col("key").alias("_k"), "candidate")
    gone = slot.join(fix, "doc_id").filter((F.col("field") == F.col("_f")) & F.col("key").eqNullSafe(F.col("_k"))).select("doc_id", "pos").distinct()
    given = packets.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "candidates").join(fix.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = given.select("doc_id", F.posexplode("candidates").alias("pos", "candidate")).join(gone, ["doc_id", "pos"], "left_anti")
    kept = kept.unionByName(fix.select("doc_id", F.lit(1 << 30).alias("pos"), "candidate"))
    whole = kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate"))), lambda x: x["candidate"]).alias("candidates"))
    return admit(given.select("doc_id", "text").join(whole, "doc_id"))


def reviewed_facts(resolved: DataFrame, slot_rows: DataFrame) -> DataFrame:
    """Facts after review: (doc_id, field, key, value, status), with open and disputed slots that have no value."""
    asked = resolved.select(*SLOT, F.col("settled").alias("value"), "status")
    on = [slot_rows[c].eqNullSafe(asked[c]) for c in SLOT]
    rest = slot_rows.filter(F.col("mode").isin("audit", "rejected")).join(asked, on, "left_anti")
    status = F.when(F.col("mode") == "audit", "admitted").otherwise("rejected")
    return asked.unionByName(rest.select(*SLOT, "value", status.alias("status")))


def review_measures(answers: DataFrame, item: str = "item") -> DataFrame:
    """Answers, reviewers, unsure answers and median time of each kind of item."""
    return answers.groupBy(item).agg(F.count("*").alias("answers"), F.countDistinct("reviewer").alias("reviewers"), F.sum((F.col("verdict") == "unsure").cast("long")).alias("unsure"), F.percentile("ms", F.lit(0.5)).alias("median_ms"))
