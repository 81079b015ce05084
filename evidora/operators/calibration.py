"""Calibration and audit: bounds, sweeps, operating points, scores, sampling by hash, the stateful pick."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_95(k: int, n: int) -> float:
    """One-sided 95 % Clopper-Pearson bound of k in n, to 4 places; 1 where there is nothing to bound."""
    if n <= 0 or k >= n:
        return 1.0
    if k == 0:
        return round(1 - 0.05 ** (1 / n), 4)
    top = math.lgamma(n + 1)
    log_terms = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    while high - low > 1e-12:
        p = (low + high) / 2
        a, b = math.log(p), math.log1p(-p)
        below = math.fsum(math.exp(t + i * a + (n - i) * b) for i, t in enumerate(log_terms))
        low, high = (p, high) if below > 0.05 else (low, p)
    return round(high, 4)


def clopper_pearson(counts: DataFrame, k: str, n: str, name: str = "bound") -> DataFrame:
    """Add the bound of each row. Distinct (k, n) are computed once."""

    @F.pandas_udf("double")
    def bound(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([upper_95(int(a), int(b)) for a, b in zip(ks, ns, strict=True)])

    kinds = counts.select(k, n).distinct().withColumn(name, bound(k, n))
    return counts.join(kinds, [k, n], "left")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k in n; null where n is 0."""
    n, k = n.cast("double"), k.cast("double")
    p = k / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    ok = n > 0
    return F.when(ok, (middle - half) / scale), F.when(ok, (middle + half) / scale)


def threshold_sweep(answers: DataFrame, p: str, right: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, cleared, escapes): answers at or above each threshold and the wrong ones among them.

    One pass of conditional sums; the thresholds are columns, then rows.
    """
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.col(p) >= t
        sums += [F.sum(hit.cast("long")).alias(f"c{i}"), F.sum((hit & ~F.col(right)).cast("long")).alias(f"e{i}")]
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("cleared"), F.coalesce(F.col(f"e{i}"), F.lit(0)).alias("escapes")) for i, t in enumerate(thresholds)))
    return answers.agg(*sums).select(F.inline(rows))


def operating_point(sweep: DataFrame, passes: Column) -> DataFrame:
    """The lowest threshold that passes; null if none does."""
    return sweep.agg(F.min(F.when(passes, F.col("threshold"))).alias("threshold"))


def route_score(labels: DataFrame, decisions: DataFrame, keys: Sequence[str], groups: Sequence[str], truth: str, value: str) -> DataFrame:
    """Labels against decisions by full outer join: scored, right, wrong, missed, unscored of each group."""
    x, y = labels.withColumn("_label", F.lit(True)), decisions.withColumn("_made", F.lit(True))
    both = x.join(y, list(keys), "full_outer")
    has_label, made = F.col("_label").isNotNull(), F.col("_made").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    same = F.col(truth).eqNullSafe(F.col(value))
    return both.groupBy(*groups).agg(count(has_label & made).alias("scored"), count(has_label & made & same).alias("right"), count(has_label & made & ~same).alias("wrong"), count(has_label & ~made).alias("missed"), count(~has_label & made).alias("unscored"))


def hash64(text: Column) -> Column:
    """The first 8 bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def picked_at(text: Column, rate: str) -> Column:
    """Whether a text falls into a sample of the given rate (a decimal string of at most 18 places): hash < rate * 2**64, exactly."""
    d = Decimal(rate)
    places = max(0, -d.as_tuple().exponent)
    limit = int(d.scaleb(places)) * 2**64
    return hash64(text).cast("decimal(38,0)") * F.lit(10**places).cast("decimal(18,0)") < F.lit(Decimal(limit)).cast("decimal(38,0)")


def calibration_half(key: Column) -> Column:
    """'calibration' where the first hex digit of the key's SHA-256 is 0 to 7, else 'test'."""
    return F.when(F.substring(F.sha2(key, 256), 1, 1) <= "7", "calibration").otherwise("test")


class AuditPick:
    """The pick of one log: every document until `minimum` items are picked, then by hash at the rate in force."""

    def __init__(self, seed: str, profile: str, minimum: int = 30, start: str = "0.1") -> None:
        self.seed, self.profile, self.minimum, self.rate, self.items = seed, profile, minimum, start, 0

    def offer(self, document: str, items: int) -> str | None:
        import hashlib

        if self.items < self.minimum:
            reason = "minimum"
        else:
            h = int.from_bytes(hashlib.sha256(f"{self.seed}:{self.profile}:{document}".encode()).digest()[:8], "big")
            d = Decimal(self.rate)
            places = max(0, -d.as_tuple().exponent)
            if h * 10**places >= int(d.scaleb(places)) * 2**64:
                return None
            reason = "rate"
        self.items += items
        return reason


def audit_pick(log: DataFrame, profile: str, order: str, document: str, items: str, seed: str, rate: str | None = None, minimum: int = 30) -> DataFrame:
    """(profile, order, document, reason) of picked documents. Which are picked decides what later rows see, so each log runs in order.

    A log streams through a task batch by batch; what is kept between batches is the state of its pick.
    """
    cols = [F.col(profile).cast("string").alias("profile"), F.col(order).cast("long").alias("ord"), F.col(document).cast("string").alias("document"), F.col(items).cast("long").alias("items"), (F.col(rate).cast("string") if rate else F.lit(None).cast("string")).alias("rate")]
    rows = log.select(*cols).repartition("profile").sortWithinPartitions("profile", "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: AuditPick | None = None
        for b in batches:
            out = []
            for p, o, d, n, r in b.itertuples(index=False):
                if state is None or state.profile != p:
                    state = AuditPick(seed, p, minimum)
                if isinstance(r, str):
                    state.rate = r
                elif reason := state.offer(d, int(n)):
                    out.append((p, o, d, reason))
            yield pd.DataFrame(out, columns=["profile", "ord", "document", "reason"])

    return rows.mapInPandas(run, "profile string, ord long, document string, reason string")


def event_shares(events: DataFrame, groups: Sequence[str], wrong: Column) -> DataFrame:
    """(groups, total, wrong, share): the share of wrong decisions, rounded up to two places."""
    out = events.groupBy(*groups).agg(F.count("*").alias("total"), F.sum(wrong.cast("long")).alias("wrong"))
    return out.withColumn("share", F.ceil(F.lit(100) * F.col("wrong") / F.col("total")) / F.lit(100.0))


def first_of_text(rows: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """The first row of each text, in the given order: texts meet by their digest, merged before the shuffle."""
    keyed = rows.withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    first = keyed.groupBy("_digest").agg(F.min(F.struct(*order)).alias("_first"))
    return keyed.join(first, "_digest").filter(F.struct(*order).eqNullSafe(F.col("_first"))).drop("_digest", "_first")


def audit_tasks(picked: DataFrame, fields: dict[str, list[str] | None]) -> DataFrame:
    """A task for each picked document, field and key; no proposed value is shown. fields: name -> keys or None."""
    slots = F.array(*(F.struct(F.lit(f).alias("field"), (F.lit(k) if k is not None else F.lit(None).cast("string")).alias("key")) for f, keys in sorted(fields.items()) for k in ([None] if keys is None else sorted(keys))))
    return picked.select("*", F.inline(slots))


def value_lines(packets: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, value, line): the line of a text that holds a corrected value as a whole word, where exactly one line does."""
    lines = packets.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    both = lines.join(values.select("doc_id", "value").filter(F.length("value") > 0), "doc_id")
    words = F.split("line", r"[^\p{L}\p{N}.,]+")
    hit = both.filter(F.array_contains(words, F.col("value")))
    return hit.groupBy("doc_id", "value").agg(F.count("*").alias("_n"), F.min("line").alias("line")).filter("_n = 1").drop("_n")


def reading_cache(sources: DataFrame, readings: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sources that a stored reading covers, with it; sources that must be read), by source, reader, options and format."""
    return sources.join(readings, list(key)), sources.join(readings.select(*key), list(key), "left_anti")


#: Code points of text before and after a value in a prompt (fixed values).
BEFORE, AFTER = 400, 150


def label_sample(rows: DataFrame, question: str, key_clear: bool = False) -> DataFrame:
    """The decisions that a person labels: for `key` those flagged KEY_NOT_AT_VALUE, for `field` those admitted.

    key_clear: the field question also takes those whose only code is KEY_NOT_AT_VALUE, which a judgment can admit. Decisions without a
    citation are not labelled.
    """
    if question not in ("key", "field"):
        raise ValueError("the question is key or field")
    flagged = F.coalesce(F.array_contains("codes", "KEY_NOT_AT_VALUE"), F.lit(False))
    wanted = flagged if question == "key" else F.coalesce(F.col("outcome") == "admitted", F.lit(False))
    if question == "field" and key_clear:
        wanted = wanted | (flagged & (F.size("codes") == 1))
    return rows.filter(F.col("start").isNotNull() & wanted)


def prompt_state(text: Column, start: Column, end: Column, before: int = BEFORE, after: int = AFTER) -> Column:
    """The text around a value, the value in brackets; places in code points."""
    first = F.greatest(start - before, F.lit(0))
    return F.concat(F.substring(text, first + 1, start - first), F.lit("["), F.substring(text, start + 1, end - start), F.lit("]"), F.substring(text, end + 1, F.lit(after)))
