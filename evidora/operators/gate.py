"""Admission of candidates as a dataflow.

A row is a document with its candidates (raw JSON texts). The text rules run in one Arrow stage, once for each
slice of a document's candidates: a document with many candidates is cut into slices so that no task
holds more than one slice of it. All that compares candidates with each other (conflicts, agreement, relations,
records, coverage) runs as DataFrame operations on the decisions.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from decimal import MAX_EMAX, MAX_PREC, MIN_EMIN, Context, Decimal
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..arrow import pieces
from ..kernel.canonical import NotCanonical, canonical, loads, quoted, text_digest
from ..kernel.gate import FLAG_ORDER, INFO_ORDER, Packet, Prepared, Template, settle
from ..kernel.schema import PacketError, Policy, Schema
from ..kernel.text import Memo, digits_hidden
from ..tables import materialize, shuffle_tasks, small_side
from . import sets

#: Candidates that one call of the text rules takes.
SLICE = 256
#: Code of each kind of set check (fixed values).
SET_CODES = {"replace": "SET_REPLACES_NOTHING", "unique": "SET_DUPLICATE", "agree": "SET_CONFLICT"}
DECISION = (
    "doc_id string, pos int, candidate_id string, candidate_sha256 string, field string, key string, proposer string, record string, "
    "outcome string, codes array<string>, value string, unit string, source string, ref string, url string, start long, `end` long, "
    "missing array<string>, parts array<struct<role:string,start:bigint,end:bigint,passed:boolean>>, place string, packet_error string, alone boolean"
)
_ARROW = pa.schema([
    ("doc_id", pa.string()), ("pos", pa.int32()), *((n, pa.string()) for n in ("candidate_id", "candidate_sha256", "field", "key", "proposer", "record", "outcome")),
    ("codes", pa.list_(pa.string())), *((n, pa.string()) for n in ("value", "unit", "source", "ref", "url")), ("start", pa.int64()), ("end", pa.int64()),
    ("missing", pa.list_(pa.string())), ("parts", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("passed", pa.bool_())]))), ("place", pa.string()), ("packet_error", pa.string()), ("alone", pa.bool_()),
])


def decisions(packets: DataFrame, schema: dict[str, Any], policy: dict[str, Any] | None = None, id_col: str = "doc_id", text_col: str = "text", candidates_col: str = "candidates", extras_col: str | None = None, tasks: int | None = None, packs: tuple[dict[str, Any], ...] = ()) -> DataFrame:
    """Steps 1 to 11 and each candidate's own flags: a row for each candidate.

    schema and policy are checked here, on the driver. extras_col: a JSON object with the members references, doubt,
    read_complete, source_url, outline, missing_pages and places. packs: vocabulary and kind packs that the schema names. tasks: deal documents out to so many tasks first, for inputs of few files. A document that is no valid packet gives one row with packet_error and no decision. alone: whether no other decision of the document that is not rejected has the field and key; false where a slice cannot tell.
    """
    Schema.of(schema, packs)
    Policy.of(policy)
    sent = packets.sparkSession.sparkContext.broadcast((schema, policy, packs))
    cols = [F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), (F.col(extras_col) if extras_col else F.lit(None).cast("string")).alias("extras"), F.col(candidates_col).alias("candidates")]
    rows = packets.select(*cols)
    rows = rows.repartition(tasks) if tasks else rows
    many = F.greatest(F.lit(1), F.ceil(F.size("candidates") / SLICE)).cast("int")
    rows = rows.withColumns({"slices": many, "slice": F.explode(F.sequence(F.lit(0), many - 1))})
    rows = rows.withColumn("candidates", F.slice("candidates", F.col("slice") * SLICE + 1, SLICE)).select("doc_id", "text", "extras", "candidates", "slice", "slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p, given = sent.value
        return decide_batches(batches, Schema.of(s, given), Policy.of(p))

    return rows.mapInArrow(run, DECISION)


def _check_extras(extras: dict[str, Any], text: str) -> None:
    """References, the read state and places of a packet. Raises PacketError."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise PacketError(what)

    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    refs = extras.get("references", [])
    need(isinstance(refs, list) and all(isinstance(x, dict) and isinstance(x.get("id"), str) and x["id"].strip() and isinstance(x.get("text"), str) for x in refs), "a reference has no id or no text")
    need(len({x["id"] for x in refs}) == len(refs), "references repeat an id")
    need(all(unicodedata.is_normalized("NFC", x["text"]) for x in refs), "a reference is not in NFC")
    at = [x["set"] for x in refs if x.get("set") is not None]
    need(all(whole(n) and 1 <= n <= 1_000_000 for n in at) and len(set(at)) == len(at), "positions in the set")
    missing = extras.get("missing_pages", [])
    need(isinstance(missing, list) and all(whole(n) and n >= 1 for n in missing), "missing pages are page numbers")
    need(not missing or extras.get("read_complete", True) is False, "a text with missing pages is not complete")
    places = extras.get("places", [])
    need(all(isinstance(x, list) and len(x) >= 3 and all(map(whole, x[:3])) for x in places), "a place has a start, an end and a page")
    size = len(text.encode())
    need(all(0 <= x[0] < x[1] <= size and x[2] >= 1 for x in places), "a place is outside of the text")
    need(all(x[1] <= y[0] and x[2] <= y[2] for x, y in zip(places, places[1:], strict=False)), "places are not in order")
    if places and not text.isascii():
        held = text.encode()
        need(all(held[i] & 0xC0 != 0x80 for x in places for i in x[:2] if i < size), "a place cuts a character")


_NAMES = [f.name for f in _ARROW]
_FIELD, _KEY, _OUTCOME = map(_NAMES.index, ("field", "key", "outcome"))


def _marked(rows: list[tuple]) -> list[tuple]:
    """The decisions of a document, alone where no other that is not rejected has their field and key."""
    if len({(r[_FIELD], r[_KEY] or "") for r in rows}) == len(rows):
        return rows
    live = Counter((r[_FIELD], r[_KEY] or "") for r in rows if r[_OUTCOME] != "rejected")
    return [(*r[:-1], live[r[_FIELD], r[_KEY] or ""] == (r[_OUTCOME] != "rejected")) for r in rows]


_in_order = itemgetter(*_NAMES)


class _Known:
    """Prepared candidates of a schema by their JSON text, and templates by that text without its digits."""

    #: Characters of a candidate up to which it is kept for documents that repeat it.
    LONGEST = 2000

    def __init__(self, schema: Schema) -> None:
        self.schema, self.ready, self.templates = schema, Memo(), Memo()

    def of(self, raw: str | None) -> Template | Prepared | tuple[Any]:
        """A template, a prepared candidate, or the candidate in a tuple. Raises what loads() does."""
        if raw is None:
            return (None,)
        if len(raw) > self.LONGEST:
            return (loads(raw),)
        if raw.isascii():
            key = digits_hidden(raw)
            found = self.templates.get(key)
            if found is None:
                found = Template.of(raw, self.schema) or False
                self.templates.put(key, found)
            if found:
                return found
        return self.ready.get(raw) or (loads(raw),)

    def prepared(self, raw: str | None, found: tuple[Any] | Prepared, packet: Packet) -> Prepared:
        if isinstance(found, tuple):
            found = Prepared(found[0], packet)
            if raw is not None and found.fixed and len(raw) <= self.LONGEST:
                self.ready.put(raw, found)
        return found


def decide_batches(batches: Iterator[pa.RecordBatch], schema: Schema, policy: Policy) -> Iterator[pa.RecordBatch]:
    """Decisions of the candidates of batches of (doc_id, text, extras, candidates, slice, slices)."""
    known = _Known(schema)
    for b in pieces(batches, 1):
        out: list[tuple] = []
        for *r, slices in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out += _decide(*r, slices, schema, policy, known)
        columns = zip(*out, strict=True) if out else [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _decide(doc_id: str, text: Any, extras: str | None, candidates: list[str | None] | None, part: int, parts: int, schema: Schema, policy: Policy, known: _Known) -> list[tuple]:
    """Rows of the decisions of a slice of a document's candidates."""
    base = part * SLICE
    try:
        if not isinstance(text, str):
            raise PacketError("the document has no text")
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            raise PacketError("the text is not in NFC")
        extras = None if extras == "{}" else extras
        if not extras:
            packet = Packet(text, schema, policy)
        else:
            extras = loads(extras)
            _check_extras(extras, text)
            doubt = [(d["start"], d["end"], d["confidence"]) for d in extras.get("doubt", ())]
            if any(a >= b for a, b, _ in doubt) or any(x[1] > y[0] for x, y in zip(doubt, doubt[1:], strict=False)):
                raise PacketError("doubt spans are not in order")
            outline = [(h["start"], h["end"], h["level"]) for h in extras.get("outline", ())]
            if any(a >= b or not 1 <= n <= 6 for a, b, n in outline) or any(x[1] > y[0] for x, y in zip(outline, outline[1:], strict=False)):
                raise PacketError("headings are not in order")
            packet = Packet(text, schema, policy, {x["id"]: x["text"] for x in extras.get("references", ())}, doubt, extras.get("read_complete", True), extras.get("source_url"), outline, extras.get("missing_pages", ()), extras.get("places", ()))
        given = [known.of(c) for c in candidates or ()]
    except (PacketError, NotCanonical, KeyError, TypeError, json.JSONDecodeError) as e:
        return [_in_order({**dict.fromkeys(_NAMES), "doc_id": doc_id, "pos": base, "packet_error": f"{type(e).__name__}: {e}", "alone": parts == 1})]
    plain = not extras and packet.document.shared and "\t" not in text
    out = []
    lone = parts == 1
    for i, found in enumerate(given):
        raw = candidates[i]
        if isinstance(found, Template):
            got = found.settle(raw, packet) if plain else None
            if got is not None:
                sha, outcome, codes, value, unit, source, start, end, place = got
                out.append((doc_id, base + i, None, sha, found.f.name, None, None, None, outcome, codes, value, unit, source, None, None, start, end, (), (), place, None, lone))
                continue
            found = (loads(raw),)
        out.append(_in_order({"doc_id": doc_id, "pos": base + i, **settle(packet, known.prepared(raw, found, packet)), "packet_error": None, "alone": lone}))
    return _marked(out) if lone and len(out) > 1 else out


def _ordered(codes: Column) -> Column:
    """Codes in the order of the receipt; reject codes stay as they are."""
    listed = F.array(*(F.lit(c) for c in (*FLAG_ORDER, *INFO_ORDER)))
    return F.when(F.col("outcome") == "rejected", codes).otherwise(F.array_intersect(listed, codes))


def _add(rows: DataFrame, code: str, when: Column) -> DataFrame:
    codes = F.when(when & (F.col("outcome") != "rejected"), F.array_append("codes", F.lit(code))).otherwise(F.col("codes"))
    outcome = F.when(when & (F.col("outcome") == "admitted"), F.lit("needs_verification")).otherwise(F.col("outcome"))
    return rows.withColumns({"codes": codes, "outcome": outcome})


def invalid_judgments(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    """Documents whose judgments name no candidate or more than one, or ask one question twice of a candidate."""
    named = rows.filter(F.col("candidate_id").isNotNull()).groupBy("doc_id", "candidate_id").agg(F.count("*").alias("_n"))
    asked = judgments.groupBy("doc_id", "candidate_id", "question").agg(F.count("*").alias("_q"))
    bad = asked.join(named, ["doc_id", "candidate_id"], "left").filter((F.coalesce("_n", F.lit(0)) != 1) | (F.col("_q") > 1))
    return bad.select("doc_id").distinct()


def judged(rows: DataFrame, judgments: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """Recorded judgments (doc_id, candidate_id, question, judge_id, judge_digest, answer, p) applied to live decisions.

    A sure answer with the candidate's key clears KEY_NOT_AT_VALUE, one with another key doubts it; so does a low
    field_match. Judgments of other judges, and questions without a threshold, change nothing.
    """
    j = Policy.of(policy).judge
    if not j:
        return rows
    unnamed, rows = rows.filter(F.col("candidate_id").isNull()), rows.filter(F.col("candidate_id").isNotNull())  # no judgment names those
    own = judgments.filter((F.col("judge_id") == j["id"]) & (F.col("judge_digest") == j["digest"]))
    said = own.groupBy("doc_id", "candidate_id").agg(F.max(F.when(F.col("question") == "key", F.struct(F.col("p"), F.col("answer")))).alias("_k"), F.max(F.when(F.col("question") == "field_match", F.col("p"))).alias("_m"))
    rows = rows.join(said, ["doc_id", "candidate_id"], "left")
    clear, doubt = j.get("clear", {}).get("KEY_NOT_AT_VALUE"), j.get("doubt", {}).get("field_match")
    no = F.lit(False)
    live = F.col("outcome") != "rejected"
    sure = live & F.coalesce(F.col("_k.p") >= clear, no) if clear is not None else no
    same = F.coalesce(F.col("_k.answer") == F.col("key"), no)
    flagged, cited = F.array_contains("codes", "KEY_NOT_AT_VALUE"), F.array_contains("codes", "KEY_CITED")
    cleared = sure & flagged & same
    doubted = sure & ~same & (flagged | cited) | (live & F.coalesce(F.col("_m") < doubt, no) if doubt is not None else no)
    codes = F.when(cleared, F.array_append(F.array_remove("codes", "KEY_NOT_AT_VALUE"), F.lit("MODEL_CLEARED"))).otherwise(F.col("codes"))
    codes = F.when(doubted, F.array_append(codes, F.lit("MODEL_DOUBT"))).otherwise(codes)
    rows = rows.withColumn("codes", codes).drop("_k", "_m")
    flags = F.size(F.array_intersect("codes", F.array(*(F.lit(c) for c in FLAG_ORDER))))
    rows = rows.withColumn("outcome", F.when(F.col("outcome") == "rejected", "rejected").when(flags > 0, "needs_verification").otherwise("admitted"))
    return rows.unionByName(unnamed)


def cross_checks(rows: DataFrame, schema: dict[str, Any], policy: dict[str, Any] | None = None, packs: tuple[dict[str, Any], ...] = (), positions: DataFrame | None = None) -> DataFrame:
    """Flags that candidates give each other: conflicts, agreement between proposers, relations, records. positions: (doc_id, ref, position) of references in the document's set.

    A decision alone in its slot, of a field in no relation or record, gets them from its own row; the others alone are shuffled.
    """
    s, p = Schema.of(schema, packs), Policy.of(policy)
    if "alone" in rows.columns:
        tied = {n for r in s.relations for n in (r.total, *(n for n, _ in r.parts))} | set(s.record_of)
        single = F.col("alone") & ~F.coalesce(F.col("field").isin(sorted(tied)), F.lit(False)) if tied else F.col("alone")
        firm = sorted(k for k, v in p.proposers.items() if v == "corroborate")
        own = rows.filter(single).drop("alone")
        if firm:
            own = _add(own, "NOT_CORROBORATED", F.coalesce(F.col("proposer").isin(firm), F.lit(False)) & F.col("packet_error").isNull() & F.col("start").isNotNull())
        own = own.withColumn("codes", _ordered(F.col("codes")))
        return cross_checks(rows.filter(~single).drop("alone"), schema, policy, packs, positions).unionByName(own)
    single = [n for n, f in s.fields.items() if not f.multiple and n not in s.record_of]
    rows = rows.withColumn("_k", F.coalesce("key", F.lit("")))
    live = rows.filter((F.col("outcome") != "rejected") & F.col("packet_error").isNull())
    key = ["doc_id", "field", "_k"]
    ends = live.filter(F.col("field").isin(single)).groupBy(*key).agg(F.min(F.struct("value", "unit")).alias("_a"), F.max(F.struct("value", "unit")).alias("_b"))
    clash = ends.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, F.lit(True).alias("_clash"))
    rows = _add(rows.join(clash, key, "left"), "CONFLICTING_CANDIDATES", F.coalesce("_clash", F.lit(False))).drop("_clash")
    if "corroborate" in p.proposers.values():
        rows = _agreement(rows, s, p)
    for r in s.relations:
        rows = _relation(rows, live, s, r)
    for f in [f for f in s.fields.values() if f.members]:
        bad = record_lines(rows, s, f, positions).filter(F.col("outcome") != "admitted").select("doc_id", "record", F.lit(True).alias("_bad"))
        rows = rows.join(bad, ["doc_id", "record"], "left")
        rows = _add(rows, "RECORD_NOT_ADMITTED", F.coalesce("_bad", F.lit(False)) & F.col("field").isin(_member_fields(f))).drop("_bad")
    return rows.withColumn("codes", _ordered(F.col("codes"))).drop("_k")


def _member_fields(f) -> list[str]:
    return [f"{f.name}.{m}" for m in f.members]


def _agreement(rows: DataFrame, s: Schema, p: Policy) -> DataFrame:
    """Candidates of one field, key and value with spans in one text: whether another proposer's span meets a row's span, and whether one lies elsewhere.

    Reads the furthest edges of each proposer that must be corroborated, and of all others together, in windows of the group:
    no pairs of candidates are made.
    """
    firm = sorted(k for k, v in p.proposers.items() if v == "corroborate")
    own = F.when(F.col("proposer").isin(firm), F.col("proposer"))  # null: one of all others
    live = (F.col("outcome") != "rejected") & F.col("packet_error").isNull() & F.col("start").isNotNull()
    rows = rows.withColumns({"_who": own, "_live": live})
    group = W.partitionBy("doc_id", "field", "_k", "value", "source", F.coalesce("ref", F.lit("")))
    order = group.orderBy("start", "pos")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    edges = {}
    for i, name in enumerate([*firm, None]):
        mine = F.col("_live") & F.col("_who").eqNullSafe(F.lit(name))
        edges |= {f"_far{i}": F.max(F.when(mine, F.col("end"))).over(before), f"_near{i}": F.min(F.when(mine, F.col("start"))).over(after)}
        edges |= {f"_last{i}": F.max(F.when(mine, F.col("start"))).over(group), f"_first{i}": F.min(F.when(mine, F.col("end"))).over(group)}
    rows = rows.withColumns(edges)
    agrees = apart = F.lit(False)
    for i, name in enumerate([*firm, None]):
        other = ~F.col("_who").eqNullSafe(F.lit(name))  # of two loose proposers none must be corroborated
        agrees = agrees | other & F.coalesce((F.col(f"_far{i}") > F.col("start")) | (F.col(f"_near{i}") < F.col("end")), F.lit(False))
        apart = apart | other & F.coalesce((F.col(f"_last{i}") >= F.col("end")) | (F.col(f"_first{i}") <= F.col("start")), F.lit(False))
    own_place = [n for n, f in s.fields.items() if f.multiple or n in s.record_of]
    rows = rows.withColumns({"_agrees": agrees, "_apart": apart & ~F.col("field").isin(own_place) if own_place else apart})
    rows = _add(rows, "NOT_CORROBORATED", F.col("_live") & F.col("_who").isNotNull() & ~F.col("_agrees"))
    return _add(rows, "OTHER_SPAN", F.col("_live") & F.col("_apart")).drop("_agrees", "_apart", "_who", "_live", *edges)


def relation_results(live: DataFrame, s: Schema, r) -> DataFrame:
    """(doc_id, id, _k, difference, allowance, holds) of each key at which a relation applies; exact decimals of any length, as text."""
    factors = {r.total: Decimal(1), **{n: -f for n, f in r.parts}}
    own = live.filter(F.col("field").isin(list(factors)))
    ends = own.groupBy("doc_id", "_k", "field").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.collect_set("place").alias("places"))
    one = ends.groupBy("doc_id", "_k").agg(F.count("*").alias("n"), F.bool_and(F.col("value") == F.col("other")).alias("single"), F.collect_list(F.struct("field", "value", "places")).alias("values"))
    one = one.filter((F.col("n") == len(factors)) & F.col("single")).select("doc_id", "_k", "values")
    tolerance, name = r.tolerance, r.id

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernel.text import plain

        exact = Context(prec=MAX_PREC, Emax=MAX_EMAX, Emin=MIN_EMIN)
        for b in batches:
            out = []
            for row in b.to_pylist():
                difference, allowance = Decimal(0), tolerance
                for v in row["values"]:
                    f = factors[v["field"]]
                    half = exact.multiply(min(map(Decimal, v["places"]), default=Decimal(1)), Decimal("0.5"))
                    difference = exact.add(difference, exact.multiply(f, Decimal(v["value"])))
                    allowance = exact.add(allowance, exact.multiply(exact.abs(f), half))
                out.append({"doc_id": row["doc_id"], "id": name, "_k": row["_k"], "difference": plain(difference), "allowance": plain(allowance), "holds": exact.abs(difference) <= allowance})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*((c, pa.string()) for c in ("doc_id", "id", "_k", "difference", "allowance")), ("holds", pa.bool_())]))

    return one.mapInArrow(check, "doc_id string, id string, _k string, difference string, allowance string, holds boolean")


def _relation(rows: DataFrame, live: DataFrame, s: Schema, r) -> DataFrame:
    failed = relation_results(live, s, r).filter(~F.col("holds")).select("doc_id", "_k", F.lit(True).alias("_fails"))
    names = [r.total, *(n for n, _ in r.parts)]
    rows = rows.join(failed, ["doc_id", "_k"], "left")
    fails = F.coalesce("_fails", F.lit(False)) & F.col("field").isin(names) & ~F.array_contains("codes", "RELATION_FAILED")
    return _add(rows, "RELATION_FAILED", fails).drop("_fails")


def record_lines(rows: DataFrame, s: Schema, f, positions: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, record, outcome, codes, source, ref, replaced, members): the records of one record field after the checks of its document set.

    Each check reads windows of (document, value of its member). positions: (doc_id, ref, position) of the references in a set.
    """
    names = _member_fields(f)
    own = rows.filter(F.col("field").isin(names) & F.col("record").isNotNull() & F.col("packet_error").isNull())
    passed = F.col("outcome") != "rejected"
    outside = F.col("source").isin("external", "knowledge")
    text = F.when(passed, F.when(outside, F.concat(F.lit("own "), F.col("pos").cast("string"))).otherwise(F.concat_ws(" ", "source", "ref")))
    agg = []
    for m, name in zip(f.members, names, strict=True):
        v = F.when(passed & (F.col("field") == name), F.col("value"))
        agg += [F.min(v).alias(f"_a_{m}"), F.max(v).alias(f"_b_{m}")]
    agg += [F.bool_or(F.col("outcome") == "needs_verification").alias("_review"), F.min(text).alias("_t"), F.max(text).alias("_u"), F.min(F.when(passed, F.struct("source", "ref"))).alias("_from")]
    out = own.groupBy("doc_id", "record").agg(*agg)
    either = lambda cs: F.exists(F.array(*cs), lambda x: x) if cs else F.lit(False)
    missing = F.col("_t").isNull() | either([F.col(f"_a_{m}").isNull() for m, x in f.members.items() if x.required])
    clash = either([F.coalesce(F.col(f"_a_{m}") != F.col(f"_b_{m}"), F.lit(False)) for m in f.members])
    mixed = F.coalesce(F.col("_t") != F.col("_u"), F.lit(False))
    out = out.withColumns({
        "_missing": missing, "_clash": clash, "_mixed": mixed, "source": F.when(~mixed, F.col("_from.source")), "ref": F.when(~mixed, F.col("_from.ref")),
        **{f"_v_{m}": F.when(F.col(f"_a_{m}") == F.col(f"_b_{m}"), F.col(f"_a_{m}")) for m in f.members},
    })
    position = F.when(F.col("source") == "document", F.lit(0))
    if positions is not None:
        out = out.join(positions.select("doc_id", "ref", F.col("position").cast("int").alias("_set")), ["doc_id", "ref"], "left")
        position = position.when(F.col("source") == "reference", F.col("_set"))
    out = out.withColumns({"_at": position.cast("int"), "replaced": F.lit(False), **{f"_c_{k}": F.lit(False) for k in SET_CODES}})
    for c in sorted((c for c in s.checks if c.field == f.name), key=lambda c: (c.check != "replace", c.id)):
        v = F.col(f"_v_{c.member}")
        alive = ~F.col("_missing") & F.col("_at").isNotNull() & v.isNotNull()
        alive = alive if c.check == "replace" else alive & ~F.col("replaced")
        group = W.partitionBy("doc_id", "_alive", v)
        out = out.withColumn("_alive", alive)
        low, high = F.min("_at").over(group), F.max("_at").over(group)
        if c.check == "replace":
            hit, more = (F.col("_at") == low) & (low > 0), {"replaced": F.col("replaced") | F.col("_alive") & (F.col("_at") < high)}
        elif c.check == "unique":
            hit, more = F.count("*").over(group) > 1, {}
        else:
            differ = either([F.coalesce(F.min(f"_v_{m}").over(group) != F.max(f"_v_{m}").over(group), F.lit(False)) for m in c.compare])
            hit, more = (low < high) & differ, {}
        out = out.withColumns({f"_c_{c.check}": F.col(f"_c_{c.check}") | F.col("_alive") & hit, **more})
    codes = [F.when(F.col(n), F.lit(code)) for n, code in (("_missing", "RECORD_MEMBER_MISSING"), ("_clash", "RECORD_MEMBER_CONFLICT"), ("_mixed", "RECORD_SOURCE_MIXED"), *((f"_c_{k}", code) for k, code in SET_CODES.items()))]
    codes = F.filter(F.array(*codes), lambda x: x.isNotNull())
    members = F.map_from_arrays(F.array(*(F.lit(m) for m in f.members)), F.array(*(F.col(f"_v_{m}") for m in f.members)))
    outcome = F.when(F.col("_missing"), "rejected").when((F.size(codes) > 0) | F.coalesce("_review", F.lit(False)), "needs_verification").otherwise("admitted")
    return out.select("doc_id", F.lit(f.name).alias("field"), "record", outcome.alias("outcome"), codes.alias("codes"), "source", "ref", "replaced", F.map_filter(members, lambda k, v: v.isNotNull()).alias("members"))


def set_positions(packets: DataFrame, id_col: str, extras_col: str) -> DataFrame:
    """(doc_id, ref, position) of the references that a packet's document set has."""
    refs = F.from_json(F.get_json_object(F.col(extras_col), "$.references"), "array<struct<id:string,set:int>>")
    each = packets.select(F.col(id_col).cast("string").alias("doc_id"), F.explode(refs).alias("r"))
    return each.filter(F.col("r.set").isNotNull()).select("doc_id", F.col("r.id").alias("ref"), F.col("r.set").alias("position"))


def coverage(packets: DataFrame, rows: DataFrame, schema: dict[str, Any], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, code): required fields without a live decision, of every valid document."""
    s = Schema.of(schema)
    required = sorted(n for n, f in s.fields.items() if f.required and n not in s.record_of)
    if not required:
        return rows.select("doc_id", "field", F.lit("").alias("code")).limit(0)
    docs = packets.select(F.col(id_col).cast("string").alias("doc_id"))
    invalid = F.col("packet_error").isNotNull()
    have = rows.filter(invalid | (F.col("outcome") != "rejected") & F.col("field").isin(required)).select("doc_id", "field", invalid.alias("_invalid"))
    for f in s.fields.values():
        if f.members and f.required:  # a record that is not rejected
            lines = record_lines(rows, s, f).filter(F.col("outcome") != "rejected")
            have = have.unionByName(lines.select("doc_id", "field", F.lit(False).alias("_invalid")))
    # one row a document: at most the required fields come together in it
    every = docs.select("doc_id", F.lit(None).cast("string").alias("field"), F.lit(False).alias("_invalid"), F.lit(True).alias("_doc")).unionByName(have.filter(F.col("doc_id").isNotNull()).withColumn("_doc", F.lit(False)))
    found = every.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col("field") == n, F.lit(False))).alias(f"_has{i}") for i, n in enumerate(required)), F.max("_invalid").alias("_invalid"), F.max("_doc").alias("_doc"))
    lacks = F.array(*(F.when(~F.col(f"_has{i}"), F.lit(n)) for i, n in enumerate(required)))
    out = found.filter(F.col("_doc") & ~F.col("_invalid")).select("doc_id", F.explode(lacks).alias("field"))
    return out.filter(F.col("field").isNotNull()).withColumn("code", F.lit("REQUIRED_FIELD_MISSING"))


def admit(packets: DataFrame, schema: dict[str, Any], policy: dict[str, Any] | None = None, judgments: DataFrame | None = None, packs: tuple[dict[str, Any], ...] = (), **options: Any) -> DataFrame:
    """Decisions of all candidates of all documents, with every flag.

    The text rules run here, once: their decisions are written to the shared folder, and the checks between candidates, which
    read them several times, start from there.
    """
    rows = materialize(decisions(packets, schema, policy, packs=packs, **options), "decisions")
    if judgments is not None:
        bad = small_side(invalid_judgments(rows, judgments)).withColumn("_bad", F.lit("its judgments name no one candidate"))
        rows = rows.join(bad, "doc_id", "left").withColumn("packet_error", F.coalesce("packet_error", "_bad")).drop("_bad")
        rows = judged(rows, judgments, policy or {})
    extras = options.get("extras_col")
    positions = set_positions(packets, options.get("id_col", "doc_id"), extras) if extras and Schema.of(schema, packs).checks else None
    return cross_checks(rows, schema, policy, packs, positions)


def receipts(rows: DataFrame, schema: dict[str, Any], policy: dict[str, Any] | None = None) -> DataFrame:
    """(doc_id, n, receipt, sha256): decisions of each document in order of digest, then position, as canonical JSON, sealed.

    A document's decisions come in order, one after the other, and are written as they come; its receipt is as long as they are.
    """
    from ..kernel.canonical import digest

    head = {"schema_sha256": Schema.of(schema).sha256, "policy_sha256": digest("policy", policy or {})}
    fields = ["candidate_sha256", "pos", "candidate_id", "field", "key", "proposer", "record", "outcome", "codes", "value", "unit", "source", "ref", "url", "start", "end", "missing", "parts"]
    own = rows.filter(F.col("packet_error").isNull()).select("doc_id", *fields)
    n = shuffle_tasks(own)
    ordered = (own.repartition(n, "doc_id") if n else own.repartition("doc_id")).sortWithinPartitions("doc_id", "candidate_sha256", "pos")

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return seal_batches(batches, head)

    return ordered.mapInArrow(seal, "doc_id string, n int, receipt string, sha256 string")


def seal_batches(batches: Iterator[pa.RecordBatch], head: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Receipts of decisions in the order of documents and receipts, written member by member."""
    rest = {k: canonical(v) for k, v in head.items()}
    now, bodies, began = None, [], False

    def sealed() -> tuple[str, int, str, str]:
        own = {**rest, "document": canonical(now), "decisions": "[" + ",".join(bodies) + "]"}
        body = "{" + ",".join([f'"{k}":{own[k]}' for k in sorted(own)]) + "}"
        return now, len(bodies), body, text_digest("receipt", body)

    def written(made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made, strict=True) if made else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n", "receipt", "sha256"])

    for b in batches:
        names = sorted(n for n in b.schema.names if n != "doc_id")
        keys, made = [f'"{n}":' for n in names], []
        rows = zip(*(b.column(n).to_pylist() for n in names), strict=True)
        for doc_id, row in zip(b.column("doc_id").to_pylist(), rows, strict=True):
            if began and doc_id != now:
                made.append(sealed())
                bodies = []
            now, began = doc_id, True
            bodies.append("{" + ",".join([k + (quoted(v) if type(v) is str and v.isascii() else str(v) if type(v) is int else _said(v)) for k, v in zip(keys, row, strict=True) if v is not None]) + "}")
        yield written(made)
    if began:
        yield written([sealed()])


def _said(value: Any) -> str:
    """Canonical JSON of a member: plain text, or a list."""
    if type(value) is str and value.isascii():
        return quoted(value)
    return "[]" if value == [] else canonical(value)


def verify(sealed: DataFrame, again: DataFrame) -> DataFrame:
    """(doc_id, status): whether a receipt comes out the same again: same, changed, missing or extra."""
    x, y = sealed.select("doc_id", F.col("sha256").alias("_a")), again.select("doc_id", F.col("sha256").alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return x.join(y, "doc_id", "full_outer").select("doc_id", status.alias("status"))


def facts(rows: DataFrame) -> DataFrame:
    """Admitted facts with their citations."""
    citation = F.struct("source", "ref", "url", "start", "end")
    return rows.filter(F.col("outcome") == "admitted").select("doc_id", "field", "key", "value", "unit", "record", citation.alias("citation"))


def summary(rows: DataFrame) -> DataFrame:
    """Outcomes and codes of each document and in all (grouping sets)."""
    codes = rows.filter(F.col("packet_error").isNull()).select("doc_id", "outcome", F.explode_outer("codes").alias("code"))
    return codes.groupingSets([["doc_id", "outcome"], ["outcome"], ["outcome", "code"]], "doc_id", "outcome", "code").agg(F.count("*").alias("n"))


def feedback(rows: DataFrame) -> DataFrame:
    """(doc_id, message): what to tell an extractor about its decisions that were not admitted; null where all were."""
    line = F.concat_ws(" ", F.concat(F.col("field"), F.lit(":")), F.concat_ws(", ", "codes"), F.when(F.size("missing") > 0, F.concat(F.lit("(missing "), F.concat_ws(", ", "missing"), F.lit(")"))))
    bad = F.when(F.col("outcome") != "admitted", F.struct("pos", line.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(bad)), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(lines.alias("_l")).select("doc_id", F.when(F.size("_l") > 0, F.concat_ws("\n", "_l")).alias("message"))
