"""Queries that run over every row of their tables, against plain loops."""

from itertools import combinations

from evidora.functions import columns as C
from evidora.kernel import text as kernel
from evidora.plans import catalogue


def run(spark, tmp_path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return catalogue.queries()[name](spark, str(tmp_path)).collect()


def test_blind_pairs_of_all_slots(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "judge")[t % 3], "x" * (c * t % 7)) for c in range(1, 26) for t in range(c % 6 + 1)]
    last = {(c, role): len(text) % 3 for c, _, role, text in sorted(rows)}
    want = {(c, a, b, last[c, a] == last[c, b]) for c in range(1, 26) for a, b in combinations(sorted(r for d, r in last if d == c), 2)}
    got = run(spark, tmp_path, "blind_pairs", conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert {(r["slot"], r["first"], r["second"], r["same"]) for r in got} == want and len(got) == len(want)


def test_every_label_is_audited(spark, tmp_path):
    rows = [(i, i % 2, i % 3 % 2) for i in range(1, 40)]
    got = run(spark, tmp_path, "audit_escapes", labels=(rows, "doc_id long, quality int, toxic int"))
    assert [tuple(r) for r in got] == [(39, sum(q != t for _, q, t in rows))]


def test_every_document_is_scored(spark, tmp_path):
    """Documents 1 to 30 and labels 11 to 40: ten documents unscored, ten labels missed."""
    docs = [(i, ("en", "de")[i % 2], 100 * i) for i in range(1, 31)]
    labels = [(i, i % 2) for i in range(11, 41)]
    got = run(spark, tmp_path, "route_score", documents=(docs, "doc_id long, lang string, n_chars long"), labels=(labels, "doc_id long, quality int"))
    by = {r["route"]: (r["scored"], r["right"], r["wrong"], r["missed"], r["unscored"]) for r in got}
    want = {"-": (0, 0, 0, 10, 0)}
    for k, lang in enumerate(("en", "de")):
        right = [i for i in range(11, 31) if i % 2 == k and (i > 10) == (i % 2)]
        want[lang] = (10, len(right), 10 - len(right), 0, 5)
    assert by == want


def test_byte_offsets_deep_in_a_text(spark, tmp_path):
    texts = ["", "a", "x" * 200 + "é\U0001f600" * 50, "ü" * 3000 + "end", None]
    got = run(spark, tmp_path, "byte_offsets", documents=(list(enumerate(texts)), "doc_id long, text string"))
    want = {i: tuple(t if t is None else len(t[: len(t) * k // 3].encode()) for k in (1, 2, 3)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["third"], r["two_thirds"], r["whole"]) for r in got} == want


def test_fold_of_every_text(spark, tmp_path):
    texts = ["Plain TEXT", "ΟΔΟΣ ΣΑΣ, ΑΣ", "İstanbul ISPARTA ılık", "Congreſs ſS", "3 \u212a", "", None]
    got = run(spark, tmp_path, "letter_fold", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["folded"] for r in got} == {i: t if t is None else kernel.fold(t) for i, t in enumerate(texts)}


def test_fold_is_by_letter(spark):
    s = "ΟΔΟΣ"
    assert spark.createDataFrame([(s,)], "t string").select(C.fold("t")).first()[0] == kernel.fold(s)
