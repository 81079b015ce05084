from pyspark.sql import functions as F

from evidora.operators import calibration
from evidora.sources.store import Store
from evidora.streaming import streams


def feed(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_origin_dedup_and_pick(spark, tmp_path):
    rows = [("x", i, f"d{i}", i % 7) for i in range(60)]
    out = []
    df = feed(spark, tmp_path, [rows], "p string, i long, d string, n long")
    picked = streams.audit_pick_stream(df, "p", "i", "d", "n", "s", start="0.5")
    streams.run_available(picked, lambda b, _: out.extend(r["ord"] for r in b.collect()), str(tmp_path / "c"))
    pick = calibration.AuditPick("s", "x", start="0.5")
    assert sorted(out) == [i for _, i, d, n in rows if pick.offer(d, n)]


def test_first_by_origin(spark, tmp_path):
    df = feed(spark, tmp_path, [[("a", 1), ("a", 2)], [("a", 3), ("b", 4)]], "origin string, v long")
    out = []
    streams.run_available(streams.first_by_origin(df, "origin"), lambda b, _: out.extend(r["origin"] for r in b.collect()), str(tmp_path / "c"))
    assert sorted(out) == ["a", "b"]


def test_continuous_admission(spark, tmp_path):
    schema = {"fields": {"f": {"type": "integer"}}}
    df = feed(spark, tmp_path, [[("d", "It is 5.", ['{"field":"f","value":"5","evidence":{"text":"5"}}'])]], "doc_id string, text string, candidates array<string>")
    out = []
    streams.run_available(streams.admit_stream(df, schema), lambda b, _: out.extend(r["outcome"] for r in b.collect()), str(tmp_path / "c"))
    assert out == ["admitted"]


def test_latest_and_chain(spark, tmp_path):
    df = feed(spark, tmp_path, [[("t", 1, "x"), ("t", 2, "y")]], "task string, n long, v string")
    out = []
    streams.run_available(streams.latest_stream(df, ["task"], "n"), lambda b, _: out.extend(r["v"] for r in b.collect()), str(tmp_path / "c"), "update")
    assert out == ["y"]
    store = Store(spark, str(tmp_path / "s"))
    q = streams.append_stream(df, store, "log", "v", str(tmp_path / "c2"), "n")
    q.processAllAvailable()
    q.stop()
    assert [r["body"] for r in store.log("log").orderBy("sequence").collect()] == ["batch:0", "x", "y"]
    assert store.check().count() == 0 and store.log("log").filter(F.col("sequence") == 1).count() == 1
