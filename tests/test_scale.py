"""What keeps time and memory in proportion to the input: work that is shared, shuffles that are not made, tasks by the number of rows."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidora.kernel import text as kernel_text
from evidora.kernel.canonical import canonical, digest
from evidora.kernel.gate import Packet, decide
from evidora.kernel.schema import Policy, Schema
from evidora.operators import extract, gate, resolution, spans
from evidora.plans import gate_queries
from evidora.sources import markup
from evidora.tables import deal, shuffle_tasks

SCHEMA = {
    "fields": {
        "a": {"unit": "USD", "minimum": "-50", "maximum": "90000"}, "n": {"type": "integer"}, "m": {"unit": "mg"}, "k": {"unit": "km2"}, "s": {"type": "string"},
        "d": {"type": "date", "formats": ["YYYY-MM-DD", "D/M/YYYY", "M/D/YYYY"]}, "al": {"aliases": ["fee"], "unit": "USD"},
    },
    "units": {"km2": {"suffix": ["km2", "km3"]}},
}
BITS = ["$", "$", " ", "\n", ". ", "-", "more than ", "up to ", " million", " thousand", "k", " mg", " mg/m2", " mg per m3", "fee ", "between ", " and ", " to ", "\t", "€", "000", "or more ", "no. ", " km2", " km3", "("]


def _number(r: random.Random) -> str:
    return r.choice([str(r.randint(0, 9)), f"{r.randint(0, 99999):,}", f"{r.randint(0, 99999) / 100:,.2f}", f"{r.randint(1990, 2003)}-{r.randint(1, 13):02d}-{r.randint(1, 31):02d}", f"{r.randint(1, 13)}/{r.randint(1, 31)}/1999", "0", "1000", "-5", "50"])


def _packets(n: int, seed: int) -> list[tuple[str, list[str]]]:
    r = random.Random(seed)
    base = ["".join(_number(r) if r.random() < 0.4 else r.choice(BITS) for _ in range(r.randint(2, 14))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = "".join(r.choice("0123456789") if c.isdigit() and r.random() < 0.3 else c for c in r.choice(base))
        made = []
        for _ in range(r.randint(0, 4)):
            f = r.choice([*SCHEMA["fields"], "none"])
            at = r.randint(0, max(0, len(t) - 1))
            quote = t[at : at + r.randint(1, 12)]
            digits = "".join(c for c in quote if c in "0123456789.,-/").strip(",./")
            c = {"field": f, "value": r.choice([digits, digits, _number(r), "null", digits + "0"]), "evidence": [{"text": quote}]}
            if unit := SCHEMA["fields"].get(f, {}).get("unit"):
                c["unit"] = r.choice([unit, unit, unit, "GBP"])
            made.append(json.dumps(c, separators=(",", ":"), ensure_ascii=False))
        out.append((t, made))
    return out


def _batches(packets: list[tuple[str, list[str]]]) -> list[pa.RecordBatch]:
    n = len(packets)
    return pa.table({"doc_id": [str(i) for i in range(n)], "text": [t for t, _ in packets], "extras": pa.array([None] * n, pa.string()), "candidates": pa.array([c for _, c in packets], pa.list_(pa.string())), "slice": pa.array([0] * n, pa.int32()), "slices": pa.array([1] * n, pa.int32())}).to_batches(200)


@pytest.mark.parametrize("seed", range(3))
def test_texts_that_share_a_shape_are_decided_as_each_alone(seed):
    packets = _packets(800, seed)
    got = [r for b in gate.decide_batches(iter(_batches(packets)), Schema.of(SCHEMA), Policy()) for r in b.to_pylist()]
    alone = []
    for i, (t, made) in enumerate(packets):
        for n, c in enumerate(made):
            alone.append({"doc_id": str(i), "pos": n, **decide(Packet(t, Schema.of(SCHEMA), Policy()), json.loads(c)), "packet_error": None})
    assert len({r["outcome"] for r in alone}) == 3
    assert [{k: v for k, v in r.items() if k != "alone"} for r in got] == alone


def test_texts_of_one_shape_are_read_once(monkeypatch):
    calls = []
    real = kernel_text.number_tokens
    monkeypatch.setattr(kernel_text, "number_tokens", lambda text: calls.append(text) or real(text))
    packets = [(f"Total: ${n}.25\n", [json.dumps({"field": "a", "value": f"{n}.25", "unit": "USD", "evidence": [{"text": f"${n}.25"}]}, separators=(",", ":"))]) for n in range(100, 400)]
    rows = [r for b in gate.decide_batches(iter(_batches(packets)), Schema.of(SCHEMA), Policy()) for r in b.to_pylist()]
    assert {r["outcome"] for r in rows} == {"admitted"} and len(rows) == 300
    assert len(calls) == 1


def test_template_gives_the_digest_of_the_candidate():
    c = {"field": "a", "value": "73.5", "unit": "USD", "evidence": [{"text": "$73.5"}]}
    for keys in (list(c), sorted(c), sorted(c, reverse=True)):
        raw = json.dumps({k: c[k] for k in keys}, separators=(",", ":"))
        row = next(gate.decide_batches(iter(_batches([("A fee of $73.5 is due", [raw])])), Schema.of(SCHEMA), Policy())).to_pylist()[0]
        assert (row["candidate_sha256"], row["outcome"], row["start"]) == (digest("candidate", c), "admitted", 9)


def test_single_decisions_are_not_shuffled_and_keep_their_flags(spark):
    schema = {"fields": {"a": {"unit": "USD"}}}
    made = lambda v, p: json.dumps({"field": "a", "value": v, "unit": "USD", "proposer": p, "evidence": [{"text": f"${v}"}]})
    text = "A fee of $5 or $7."
    packets = spark.createDataFrame([("one", text, [made("5", "firm")]), ("two", text, [made("5", "x"), made("7", "x")]), ("same", text, [made("5", "firm"), made("5", "x")]), ("half", text, [made("5", "x"), made("9", "x")])], "doc_id string, text string, candidates array<string>")
    rows = gate.admit(packets, schema, {"proposers": {"firm": "corroborate"}})
    got = {(r["doc_id"], r["pos"]): (r["outcome"], ",".join(r["codes"])) for r in rows.collect()}
    clash = ("needs_verification", "CONFLICTING_CANDIDATES")
    assert got == {("one", 0): ("needs_verification", "NOT_CORROBORATED"), ("two", 0): clash, ("two", 1): clash, ("same", 0): ("admitted", ""), ("same", 1): ("admitted", ""), ("half", 0): ("admitted", ""), ("half", 1): ("rejected", "QUOTE_NOT_FOUND")}
    lone = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in lone and "alone" not in rows.columns


def test_receipts_are_the_canonical_text(spark):
    rows = gate.admit(spark.createDataFrame([("ä\"1", "A fee of $5.", [json.dumps({"field": "a", "value": "5", "unit": "USD", "proposer": 'q"\\ü\n', "evidence": [{"text": "$5"}, {"role": "field", "text": "fee"}]}), "7"]), ("b", "none", [])], "doc_id string, text string, candidates array<string>"), {"fields": {"a": {"unit": "USD"}}})
    got = gate.receipts(rows, {"fields": {"a": {"unit": "USD"}}}).collect()
    assert [r["n"] for r in got] == [2]
    assert canonical(json.loads(got[0]["receipt"])) == got[0]["receipt"] and "ü" in got[0]["receipt"] and '"parts":[{' in got[0]["receipt"]


def test_second_receipts_are_dealt_over_as_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id as o_orderkey", "cast(id + 1000 as double) as o_totalprice", "date'1995-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    dealt = []
    monkeypatch.setattr(gate_queries, "deal", lambda df, *keys: dealt.append((keys, (out := deal(df, *keys, each=200)).rdd.getNumPartitions())) or out)
    assert [tuple(r) for r in gate_queries.receipt_verify(spark, str(tmp_path)).collect()] == [("same", 4000)]
    assert dealt == [((), 20), (("o_orderkey",), 20)]


def test_coverage_takes_one_shuffle(spark):
    schema = {"fields": {"a": {"unit": "USD", "required": True}, "n": {"type": "integer", "required": True}}}
    good = json.dumps({"field": "a", "value": "5", "unit": "USD", "evidence": [{"text": "$5"}]})
    packets = spark.createDataFrame([("x", "It is $5.", [good]), ("y", "It is $5.", []), ("z", None, [good]), (None, "It is $5.", [good])], "doc_id string, text string, candidates array<string>")
    out = gate.coverage(packets, gate.admit(packets, schema), schema)
    assert sorted((r["doc_id"] or "", r["field"], r["code"]) for r in out.collect()) == [("", "a", "REQUIRED_FIELD_MISSING"), ("", "n", "REQUIRED_FIELD_MISSING"), ("x", "n", "REQUIRED_FIELD_MISSING"), ("y", "a", "REQUIRED_FIELD_MISSING"), ("y", "n", "REQUIRED_FIELD_MISSING")]
    rows = spark.createDataFrame([("x", "a", "admitted", None)], "doc_id string, field string, outcome string, packet_error string")
    assert "Join" not in gate.coverage(packets, rows, schema)._jdf.queryExecution().optimizedPlan().toString()


def test_slots_come_from_one_aggregate(spark):
    rows = spark.createDataFrame([("x", "a", None, 0, "admitted", "5"), ("x", "b", None, 1, "rejected", None), ("x", "c", "k", 2, "admitted", "1"), ("x", "c", "k", 3, "admitted", "1"), ("x", "m", None, 4, "admitted", "1"), ("x", "m", None, 5, "admitted", "2")], "doc_id string, field string, key string, pos int, outcome string, value string")
    out = resolution.slots_of(rows, ["m"])
    assert sorted((r["field"], r["decisions"], r["mode"], r["value"]) for r in out.collect()) == [("a", [0], "audit", "5"), ("b", [1], "rejected", None), ("c", [2, 3], "review", None), ("m", [4], "audit", "1"), ("m", [5], "audit", "2")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_structure_candidates_keep_their_text(spark):
    docs = spark.createDataFrame([("1", "Items: 5\nFee: $3\n"), ("2", None)], "doc_id string, text string")
    got = extract.structure_candidates(docs, {"fields": {"items": {"type": "integer", "aliases": ["Items"]}}}, keep_text=True).collect()
    assert [(r["doc_id"], r["text"], len(r["candidates"])) for r in got] == [("1", "Items: 5\nFee: $3\n", 1), ("2", None, 0)]


def test_shuffles_have_tasks_by_the_number_of_rows(spark):
    assert shuffle_tasks(spark.range(1000)) is None and shuffle_tasks(spark.range(1000), spark.range(1000), each=100) == 20
    many = spark.range(3_000_000)
    values = many.selectExpr("id as k", "cast(id as decimal(18,0)) as v", "cast(1 as decimal(18,0)) as p")
    assert extract.without_rounded(values, ["k"], "v", "p").rdd.getNumPartitions() == 12
    words = many.selectExpr("id as k", "0 as ws", "1 as we", "1 as page", "0 as a", "0 as b", "1 as c", "1 as d")
    at = spark.range(10).selectExpr("id as k", "0 as s", "1 as e")
    boxes = spans.locators(at, words, ["k"], ["k"], "s", "e", "ws", "we", "page", ["a", "b", "c", "d"])
    assert "REPARTITION_BY_NUM" in boxes._jdf.queryExecution().executedPlan().toString() and boxes.count() == 10


def test_pages_are_read_once_for_their_cells(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>x</td><td>7</td></tr></table>")], "page_id int, html string")
    cells = markup.labelled_cells(markup.node_rows(markup.read_markup(pages, "page_id", "html"), "page_id"), "page_id")
    assert [(r["label"], r["header"], r["value"]) for r in cells.collect()] == [("x", "b", "7")]
    assert "MapInArrow" not in cells._jdf.queryExecution().optimizedPlan().toString()
    assert cells.filter(F.col("value").isNull()).count() == 0
