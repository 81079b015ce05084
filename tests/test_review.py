import json

from pyspark.sql import functions as F

from evidora import __main__ as cli
from evidora.operators import extract, gate, measure, resolution

SCHEMA = {"fields": {"fee": {"unit": "USD", "aliases": ["fee", "annual fee"], "required": True}, "term": {"type": "string", "aliases": ["term"]}}}


def packets(spark, *rows):
    return spark.createDataFrame([(d, t, [json.dumps(c) for c in cs]) for d, t, *cs in rows], "doc_id string, text string, candidates array<string>")


def fee(value, quote):
    return {"field": "fee", "value": value, "unit": "USD", "evidence": [{"text": quote}]}


def test_resolution(spark):
    p = packets(spark, ("a", "Fee $5.", fee("5", "$5")), ("b", "Fee $5 or $6.", fee("5", "$5"), fee("6", "$6")), ("c", "none"), ("d", "Fee $5.", fee("7", "$5")))
    rows = gate.admit(p, SCHEMA)
    slots = resolution.slots_of(rows, [])
    assert {r["doc_id"]: r["mode"] for r in slots.collect()} == {"a": "audit", "b": "review", "d": "rejected"}
    tasks = resolution.tasks_of(slots, gate.coverage(p, rows, SCHEMA), audit_rate="1").cache()
    assert {(r["doc_id"], r["mode"]) for r in tasks.collect()} == {("a", "audit"), ("b", "review"), ("c", "missing"), ("d", "missing")}
    name = {r["doc_id"]: r["task"] for r in tasks.collect()}
    answers = [(name["a"], "x", 1, "confirm", None), (name["b"], "x", 1, "choose", "6"), (name["b"], "x", 2, "choose", "5"), (name["b"], "y", 1, "choose", "5"), (name["c"], "x", 1, "not_in_document", None), (name["c"], "y", 1, "correct", "9"), (name["d"], "x", 1, "unsure", None)]
    df = spark.createDataFrame(answers, "task string, reviewer string, sequence long, verdict string, target string")
    done = resolution.resolve(tasks, df)
    assert {r["doc_id"]: (r["status"], r["settled"]) for r in done.collect()} == {"a": ("admitted", "5"), "b": ("chosen", "5"), "c": ("disputed", None), "d": ("open", None)}
    led = resolution.resolve(tasks, df, lead=F.col("reviewer") == "y")
    assert {r["doc_id"]: r["status"] for r in led.collect()}["c"] == "corrected"
    assert resolution.reviewed_facts(done, slots).count() == 4
    fix = spark.createDataFrame([("d", "fee", None, json.dumps(fee("5", "$5")))], "doc_id string, field string, key string, candidate string")
    again = resolution.corrected(rows, fix, p, lambda x: gate.admit(x, SCHEMA))
    assert [(r["doc_id"], r["outcome"], r["value"]) for r in again.collect()] == [("d", "admitted", "5")]


def test_measure(spark):
    rows = spark.createDataFrame([("d1", "f", "k", "5", "admitted", [], None), ("d2", "f", "k", "5", "needs_verification", ["KEY_NOT_AT_VALUE"], 0.8), ("d3", "f", "k", "5", "needs_verification", ["KEY_NOT_AT_VALUE"], 0.6), ("d4", "f", "k", "5", "needs_verification", ["SCALE_WORD"], 0.9)], "doc_id string, field string, key string, value string, outcome string, codes array<string>, p double")
    labels = spark.createDataFrame([("d1", "f", "k", "5"), ("d2", "f", "k", "5"), ("d3", "f", "k", "6"), ("d4", "f", "k", "5"), ("d5", "f", "k", None)], "doc_id string, field string, key string, value string")
    got = measure.scores(rows, labels, [0.5, 0.7]).groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("cleared", "escapes", "missed", "n")))
    assert {tuple(r) for r in got.collect()} == {(0.5, 3, 1, 2, 5), (0.7, 2, 0, 2, 5)}
    scored = spark.createDataFrame([("calibration", "f", 0.5, 100, 9, 0, 100), ("calibration", "f", 0.7, 90, 0, 0, 100), ("test", "f", 0.7, 95, 0, 0, 100)], "part string, field string, threshold double, cleared long, escapes long, missed long, n long")
    r = measure.operating_points(scored, 0.05).collect()[0]
    assert (r["threshold"], r["status"]) == (0.7, "measured") and r["bound"] < 0.05
    profile = measure.draft_profile({"policy": {"judge": {"id": "j", "digest": "1"}}}, measure.operating_points(scored, 0.05), "2025-01-01")
    assert profile["policy"]["judge"]["clear"] == {"KEY_NOT_AT_VALUE": 0.7} and profile["routes"][0]["status"] == "measured"
    assert measure.pooled(scored).filter(F.col("field").isNull()).count() == 3


def replies():
    """Functions as a user's script has them, not of a module that executors can import."""
    import json

    def reply(prompt):
        if "broken" in prompt and "not usable" not in prompt:
            return "no json"
        found = {"field": "fee", "value": "5", "unit": "USD", "evidence": [{"text": "$5"}]}
        return json.dumps({"candidates": [found] if "$5" in prompt else []})

    return reply, lambda chunk: f"Read: {chunk}", lambda chunk: chunk


def test_runner_and_replay(spark):
    docs = spark.createDataFrame([("a", "The fee is $5."), ("b", "broken, the fee is $5."), ("c", None)], "doc_id string, text string")
    reply, same_prompt, other_prompt = replies()
    record = extract.run(docs, reply, same_prompt).cache()
    assert sorted((r["doc_id"], r["step"], r["error"] is None) for r in record.collect()) == [("a", 0, True), ("b", 0, False), ("b", 1, True)]
    found = extract.candidates_of(record)
    out = gate.admit(docs.join(found, "doc_id"), SCHEMA)
    assert {(r["doc_id"], r["outcome"]) for r in out.collect()} == {("a", "admitted"), ("b", "admitted")}
    assert extract.replay(record, docs, same_prompt).count() == 0
    assert extract.replay(record, docs, other_prompt).count() > 0


def test_structure_proposals(spark):
    docs = spark.createDataFrame([("a", "Annual fee: $5\nTerm:\t12 months\nFee: $1 or $2\n"), ("b", None)], "doc_id string, text string")
    found = extract.structure_candidates(docs, SCHEMA)
    out = gate.admit(docs.join(found, "doc_id"), SCHEMA)
    assert sorted((r["field"], r["value"], r["outcome"], r["proposer"]) for r in out.filter("packet_error is null").collect()) == [("fee", "5", "admitted", "structure"), ("term", "12 months", "admitted", "structure")]


def test_search_and_plan():
    text = "intro\n" + "x\n" * 300 + "the annual fee is due\n" + "y\n" * 300 + "a late fee\n"
    regions = extract.search(text, ["annual fee", "fee"], reach=20, most=1)
    assert len(regions) == 1 and "annual fee" in text[slice(*regions[0])]
    assert "late fee" in text[slice(*extract.search(text, ["annual fee", "fee"], reach=20, most=1, page=1)[0])]
    assert extract.packed_nodes([(0, 3), (3, 6), (6, 20), (20, 22)], 7) == [(0, 6), (6, 20), (20, 22)]
    for bad in ("", "[]", '{"candidates": 1}', '{"candidates": [], "x": 1}', '{"candidates": [{"field": "f", "value": "1", "proposer": "me"}]}', '{"candidates": [], "candidates": []}'):
        try:
            extract.parse_reply(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_rounded_values_go(spark):
    df = spark.createDataFrame([("a", "1300"), ("a", "1250"), ("a", "1251"), ("b", "1300")], "k string, v string").select("k", F.col("v").cast("decimal(18,2)").alias("v"), F.when(F.col("v") == "1300", 100).when(F.col("v") == "1250", 10).otherwise(1).cast("decimal(18,2)").alias("place"))
    assert sorted((r["k"], int(r["v"])) for r in extract.without_rounded(df, ["k"], "v", "place").collect()) == [("a", 1251), ("b", 1300)]


def test_planted_table(spark):
    df = spark.createDataFrame([("x", "admitted"), ("x", "rejected"), ("y", "rejected")], "c string, outcome string")
    assert {tuple(r) for r in measure.planted_table(df, "c").collect()} == {("x", 2, 0.5, 0.0, 0.5), ("y", 1, 0.0, 0.0, 1.0)}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    packets(spark, ("a", "Fee $5.", fee("5", "$5")), ("b", "none")).write.parquet(str(tmp_path / "p"))
    args = [str(tmp_path / "p"), str(tmp_path / "s.json"), str(tmp_path / "out")]
    assert cli.main(["admit", *args]) == 0 and cli.main(["verify", *args]) == 0
    assert cli.main(["export", str(tmp_path / "out"), str(tmp_path / "facts")]) == 0
    assert spark.read.json(str(tmp_path / "facts")).count() == 1
    assert cli.main(["schema", "check", str(tmp_path / "s.json")]) == 0 and cli.main(["packs"]) == 0 and cli.main(["bound", "0", "10"]) == 0
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["schema", "check", str(tmp_path / "bad.json")]) == 1
    assert "0.2589" in capsys.readouterr().out


def test_page_after_a_null(spark):
    from evidora.operators import review

    rows = spark.createDataFrame([(a, b) for a in (None, 1, 2) for b in (None, 1, 2)], "a int, b int")
    want = sorted([(r["a"], r["b"]) for r in rows.collect()], key=lambda x: [(v is not None, v or 0) for v in x])
    at, got = None, []
    while page := review.page(rows, ["a", "b"], at, 2).collect():
        got += [tuple(r) for r in page]
        at = got[-1]
    assert got == want


def test_answers_count_up_to_a_fault(spark):
    from evidora.operators import review

    tasks = spark.createDataFrame([("t", "number", [0, 1]), ("u", "closed_set", [0]), ("e", "text", [])], "task string, item string, choices array<int>")
    rows = [
        ("a", 1, "t", "choose", 1, None, 1, 1), ("a", 2, "t", "choose", 2, None, 1, 1), ("a", 3, "t", "unsure", None, None, 1, 1),
        ("b", 1, "u", "correct", None, "c", 1, 1), ("c", 1, "t", "confirm", None, None, 1, 1), ("d", 1, "u", "confirm", None, None, 1, 1),
        ("d", 2, "t", "correct", None, "c", 1, 1), ("d", 3, "e", "adjust_span", None, None, 1, 1), ("f", 1, "x", "unsure", None, None, 1, 1),
        ("g", 1, "t", None, None, None, 1, 1), ("h", 1, "t", "unsure", None, None, -1, 1), ("i", 1, "t", "unsure", 0, None, 1, 1),
        ("j", 1, "t", "unsure", None, "c", 1, None), (None, 1, "t", "unsure", None, None, 1, 1), ("k", None, "t", "unsure", None, None, 1, 1),
        ("k", 5, "t", "unsure", None, None, 1, 1), ("l", 1, "e", "confirm", None, None, 1, 1), ("m", 1, None, "unsure", None, None, 1, 1),
    ]
    answers = spark.createDataFrame(rows, "reviewer string, sequence long, task string, verdict string, decision int, candidate string, keys int, ms int")
    got = {(r["reviewer"], r["sequence"]): (r["fault"], r["counts"]) for r in review.check_answers(answers, tasks).collect()}
    assert len(got) == len(rows)
    want = {("a", 2): "decision", ("b", 1): "closed_set", ("c", 1): "confirm", ("d", 3): "candidate", ("f", 1): "task", ("g", 1): "verdict", ("h", 1): "counts", ("i", 1): "decision", ("j", 1): "counts", ("k", None): "sequence", ("l", 1): "confirm", ("m", 1): "task"}
    assert {k: f for k, (f, _) in got.items() if f} == want
    assert {k for k, (_, counts) in got.items() if counts} == {("a", 1), ("d", 1), ("d", 2), (None, 1)}
    assert review.check_answers(answers.limit(0), tasks).count() == 0


def test_blind_tasks_hide_what_decides(spark):
    from evidora.operators import review

    rows = spark.createDataFrame([("t", "review", "number", "fee", [(7, "5"), (9, None)]), ("u", "audit", "number", "fee", [(7, "5")]), ("v", "audit", "closed_set", "fee", [(7, "5")]), ("w", None, None, None, None)], "task string, mode string, item string, field string, choices array<struct<decision:int,value:string>>")
    got = {r["task"]: r["choices"] for r in review.blind(rows).collect()}
    assert got == {"t": [(0, "5"), (1, None)], "u": None, "w": None}


def test_label_samples_prompts_and_recall(spark):
    from evidora.operators import calibration

    rows = spark.createDataFrame([(1, "admitted", [], 0), (2, "needs_verification", ["KEY_NOT_AT_VALUE"], 0), (3, "needs_verification", ["QUALIFIED_VALUE", "KEY_NOT_AT_VALUE"], 0), (4, "admitted", [], None), (5, None, None, 0)], "id int, outcome string, codes array<string>, start long")
    ids = lambda *a, **k: sorted(r["id"] for r in calibration.label_sample(rows, *a, **k).collect())
    assert ids("key") == [2, 3] and ids("field") == [1] and ids("field", key_clear=True) == [1, 2]
    text = "x" * 500 + "41" + "y" * 300
    window = lambda t, a, b: spark.range(1).select(calibration.prompt_state(F.lit(t), F.lit(a), F.lit(b)).alias("s")).first()["s"]
    assert window(text, 500, 502) == "x" * 400 + "[41]" + "y" * 150 and window("41", 0, 2) == "[41]" and window("", 0, 0) == "[]" and window(None, 0, 0) is None
    gold = spark.createDataFrame([("a", "k", "1"), ("a", "k", "1"), ("a", None, "2"), ("b", "k", "1")], "doc string, key string, value string")
    made = spark.createDataFrame([("a", "k", "1", "admitted"), ("a", "k", "1", "rejected"), ("a", None, "2", "needs_verification"), ("b", "k", "1", "rejected"), ("c", "k", "1", "admitted")], "doc string, key string, value string, outcome string")
    assert tuple(measure.recall(gold, made, ["doc", "key", "value"]).first()) == (3, 1, 2)
    assert tuple(measure.recall(gold.limit(0), made, ["doc", "key", "value"]).first()) == (0, 0, 0)
