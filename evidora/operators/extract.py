"""The proposer's side: chunk plans, targeted search, replies to candidates, structure proposals, rounding, replay.

Model calls are an injected callable that takes a prompt and returns a reply; every call is a row of a run record,
from which a run can be replayed without the model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.canonical import NotCanonical, loads, text_digest
from ..kernel.text import Shapes, Text, fold
from ..tables import shuffle_tasks, spread
from .chunks import windows_of

# ---------------------------------------------------------------- fixed limits
MOST_REGIONS, MOST_PROMPT = 8, 1 << 16
# ------------------------------------------------------------------------------


def packed_nodes(nodes: Sequence[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Consecutive node spans joined in order while they fit; a longer node is a chunk of its own."""
    out: list[tuple[int, int]] = []
    for start, end in nodes:
        if out and end - out[-1][0] <= size:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def plan(text: str, nodes: Sequence[tuple[int, int]] | None, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of a text: along its nodes where it has any, each of those over the size cut into windows."""
    spans = packed_nodes(nodes, size) if nodes else [(0, len(text))]
    return [(s + a, s + b) for s, e in spans for a, b in windows_of(text[s:e], size, overlap)]


def search(text: str, queries: Sequence[str], reach: int = 400, most: int = MOST_REGIONS, page: int = 0) -> list[tuple[int, int]]:
    """Regions around matches of the queries: windows merged where they touch, the best `most` by how many queries they hold, then by place.

    A query word that stands in more than half of a text's lines tells nothing and is left out. page: the next best regions (second sweep).
    """
    low = fold(text)
    lines = low.count("\n") + 1
    hits: list[tuple[int, int, int]] = []
    for n, q in enumerate(dict.fromkeys(fold(x) for x in queries if x.strip())):
        pattern = regex.compile(r"(?<![\p{L}\p{N}])" + r"\s+".join(map(regex.escape, q.split())) + r"(?![\p{L}\p{N}])")
        found = [m.span() for m in pattern.finditer(low)]
        if lines > 3 and len({low.count("\n", 0, s) for s, _ in found}) * 2 > lines:
            continue
        hits += [(s, e, n) for s, e in found]
    merged: list[list] = []
    for s, e, n in sorted(hits):
        a, b = max(0, s - reach), min(len(text), e + reach)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
            merged[-1][2].add(n)
        else:
            merged.append([a, b, {n}])
    ranked = sorted(merged, key=lambda r: (-len(r[2]), r[0]))[page * most : (page + 1) * most]
    return sorted((a, b) for a, b, _ in ranked)


def parse_reply(reply: str) -> list[dict[str, Any]]:
    """Candidates of a reply: one strict JSON object with a list `candidates`, in a code fence or not. Raises ValueError."""
    m = regex.fullmatch(r"\s*(?:```(?:json)?\s*)?(\{.*\})\s*(?:```)?\s*", reply, regex.DOTALL)
    if not m:
        raise ValueError("the reply holds no JSON object")
    try:
        body = loads(m[1])
    except (NotCanonical, json.JSONDecodeError) as e:
        raise ValueError(f"the reply is no strict JSON: {e}") from e
    if not isinstance(body, dict) or set(body) != {"candidates"} or not isinstance(body["candidates"], list):
        raise ValueError("the reply is not an object with candidates alone")
    for c in body["candidates"]:
        if not isinstance(c, dict) or not isinstance(c.get("field"), str) or not isinstance(c.get("value"), (str, int)) or "proposer" in c:
            raise ValueError("a candidate has the wrong shape")
    return body["candidates"]


def anchored(text: str, candidate: Mapping[str, Any], region: tuple[int, int]) -> dict[str, Any]:
    """A candidate with spans in place of quotes that stand once in its region, and that region."""
    t = Text(text)
    out = dict(candidate)
    items = candidate.get("evidence", [])
    fixed = []
    for i in [items] if isinstance(items, Mapping) else items:
        spots = t.occurrences(i["text"], *region) if isinstance(i.get("text"), str) and "start" not in i else []
        fixed.append({**i, "start": t.to_bytes(spots[0][0]), "end": t.to_bytes(spots[0][1])} if len(spots) == 1 else dict(i))
    out["evidence"] = fixed
    out["search_region"] = {"start": t.to_bytes(region[0]), "end": t.to_bytes(region[1])}
    return out


RUN = "doc_id string, step int, start int, `end` int, prompt_sha256 string, reply string, error string, candidates array<string>"
_RUN = pa.schema([("doc_id", pa.string()), ("step", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("prompt_sha256", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("candidates", pa.list_(pa.string()))])


def _steps(doc: str, text: str, ask_for: Callable[[int, str], str | None], prompt: Callable[[str], str], size: int, overlap: int, rounds: int) -> list[dict[str, Any]]:
    """The calls of one document. ask_for gives the reply to a step's prompt, None where a replay has no more."""
    out: list[dict[str, Any]] = []
    for s, e in plan(text, None, size, overlap):
        ask = prompt(text[s:e])
        for _ in range(1 + rounds):
            if len(ask) > MOST_PROMPT:  # no call is made; the chunk is not cut in silence
                out.append({"doc_id": doc, "step": len(out), "start": s, "end": e, "prompt_sha256": text_digest("prompt", ask), "reply": None, "error": f"the prompt has {len(ask)} of {MOST_PROMPT} characters", "candidates": []})
                break
            reply = ask_for(len(out), ask)
            if reply is None:
                break
            error, found = None, []
            try:
                found = [json.dumps(anchored(text, c, (s, e)), ensure_ascii=False, sort_keys=True) for c in parse_reply(reply)]
            except ValueError as x:
                error = str(x)
            out.append({"doc_id": doc, "step": len(out), "start": s, "end": e, "prompt_sha256": text_digest("prompt", ask), "reply": reply, "error": error, "candidates": found})
            if error is None:
                break
            ask = f"{ask}\n\nThe last reply was not usable: {error}"
    return out


def run(docs: DataFrame, client: Callable[[str], str], prompt: Callable[[str], str], size: int = 6000, overlap: int = 300, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The run record: a row for each call. A reply that cannot be read is asked for again with the error, `rounds` times at most."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                made = _steps(r["id"], r["text"] or "", lambda n, ask: client(ask), prompt, size, overlap, rounds)
                yield pa.RecordBatch.from_pylist(made, schema=_RUN)

    return rows.mapInArrow(calls, RUN)


def candidates_of(record: DataFrame) -> DataFrame:
    """(doc_id, candidates) of a run record, in order of its steps, equal candidates once."""
    each = record.filter(F.col("error").isNull()).select("doc_id", "step", F.posexplode("candidates").alias("n", "candidate"))
    first = each.groupBy("doc_id", "candidate").agg(F.min(F.struct("step", "n")).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "candidate"))), lambda x: x["candidate"])
    return first.groupBy("doc_id").agg(ordered.alias("candidates"))


def replay(record: DataFrame, docs: DataFrame, prompt: Callable[[str], str], size: int = 6000, overlap: int = 300, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in which a run that is fed the recorded replies differs from its record; none if it is the same."""
    replies = record.groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("step", "reply"))).alias("replies"))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(replies, "id", "left")

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                said = dict(r["replies"] or ())
                made = _steps(r["id"], r["text"] or "", lambda n, ask: said.get(n), prompt, size, overlap, rounds)  # noqa: B023
                yield pa.RecordBatch.from_pylist(made, schema=_RUN)

    again = rows.mapInArrow(calls, RUN)
    return record.exceptAll(again).withColumn("side", F.lit("record")).unionByName(again.exceptAll(record).withColumn("side", F.lit("again")))


def labelled_lines(text: str, fields: Mapping[str, Sequence[str]]) -> list[tuple[str, int, int, int, int]]:
    """(field, label start, label end, value start, value end) of lines `label: value` and `label<tab>value` whose label is an alias of a field."""
    return _labelled(text, _label_names(fields))


def _label_names(fields: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {" ".join(fold(a).split()): f for f, words in fields.items() for a in words}


_LABELLED = regex.compile(r"\s*(.*?\S)\s*(?::|\t)\s*(\S.*?)\s*(?:\t.*)?$")


def _labelled(text: str, names: Mapping[str, str]) -> list[tuple[str, int, int, int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        m = _LABELLED.match(line) if ":" in line or "\t" in line else None
        if m and (f := names.get(" ".join(fold(m[1]).split()))):
            out.append((f, at + m.start(1), at + m.end(1), at + m.start(2), at + m.end(2)))
        at += len(line) + 1
    return out


def structure_candidates(docs: DataFrame, schema: Mapping[str, Any], id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, candidates): what labelled lines propose for fields with aliases; proposer `structure`, value and field cited. keep_text: with the text, as packets."""
    fields = {n: f for n, f in schema["fields"].items() if f.get("aliases")}
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shapes = _label_names({n: x["aliases"] for n, x in fields.items()}), Shapes()
        for b in batches:
            ids, texts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for text in texts:
                t, made = Text(text or "", shapes=shapes), []
                for f, a, e, s, z in _labelled(t.text, names):
                    kind = fields[f].get("type", "number")
                    values: list[tuple[str, int, int]] = [(t.text[s:z], s, z)] if kind == "string" else [(format(x.value, "f"), x.start, x.end) for x in t.tokens_in(s, z) if x.value is not None]
                    if len(values) != 1:
                        continue
                    v, s, z = values[0]
                    item = lambda role, i, j: {"role": role, "start": t.to_bytes(i), "end": t.to_bytes(j)}  # noqa: E731, B023
                    c = {"field": f, "value": v, "proposer": "structure", "evidence": [item("value", s, z), item("field", a, e)]}
                    if fields[f].get("unit"):
                        c["unit"] = fields[f]["unit"]
                    made.append(json.dumps(c, ensure_ascii=False, sort_keys=True))
                out.append(made)
            columns = {"doc_id": pa.array(ids, pa.string()), **({"text": b.column(1)} if keep_text else {}), "candidates": pa.array(out, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(propose, f"doc_id string, {'text string, ' if keep_text else ''}candidates array<string>")


def without_rounded(values: DataFrame, keys: Sequence[str], value: str, place: str) -> DataFrame:
    """Rows without those that another value of the same keys, of a finer place, rounds to.

    Decimals; a value is a multiple of its place. Each value is rounded, both ways at a half, to every coarser place that its keys
    have: few, and each rounded value once. So rows meet what they round to by an equi join, without pairs of a band. Shuffles have
    tasks by the number of rows, so what a task holds does not grow with them.
    """
    n = shuffle_tasks(values)
    values = spread(values, n, *keys)
    exact = "decimal(38,10)"
    v, p = F.col(value).cast(exact), F.col(place).cast(exact)
    fine = values.select(*keys, v.alias("_v"), p.alias("_p")).distinct()
    coarse = values.select(*keys, p.alias("_to")).distinct()
    steps = F.floor((F.col("_v") / F.col("_to")).cast(exact))
    low = (steps * F.col("_to")).cast(exact)
    gap = (F.col("_v") - low).cast(exact)
    near = F.array(F.when(gap * 2 <= F.col("_to"), low), F.when(gap * 2 >= F.col("_to"), (low + F.col("_to")).cast(exact)))
    hit = fine.join(coarse, list(keys)).filter(F.col("_to") > F.col("_p")).select(*keys, "_v", "_to", F.explode(near).alias("_at"))
    hit = hit.filter(F.col("_at").isNotNull() & (F.col("_at") != F.col("_v"))).select(*keys, "_to", "_at").distinct()
    rows = spread(values.withColumns({"_to": p, "_at": v}), n, *keys, "_to", "_at")
    return rows.join(spread(hit, n, *keys, "_to", "_at"), [*keys, "_to", "_at"], "left_anti").select(*values.columns)
