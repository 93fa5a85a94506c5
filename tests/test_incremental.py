"""Resumable runs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from attestor.functions.hashing import run_fingerprint
from attestor.functions.strings import label
from attestor.streaming import incremental as inc


def process(d):
    return d.withColumn("y", F.col("k") * 10)


def test_resume_in_steps(spark, tmp_path):
    work = spark.range(10).withColumnRenamed("id", "k")
    at, mark = str(tmp_path / "run"), run_fingerprint(model="m", seed=1)
    left = [inc.Run(spark, at, mark, "k long, y long").step(work, ["k"], process, 4) for _ in range(3)]
    assert left == [6, 2, 0]
    run = inc.Run(spark, at, mark, "k long, y long")
    assert run.step(work, ["k"], process) == 0 and run.done().count() == 10
    assert {r.k: r.y for r in run.done().collect()} == {k: 10 * k for k in range(10)}
    with pytest.raises(ValueError, match="another run"):
        inc.Run(spark, at, run_fingerprint(model="m", seed=2), "k long, y long")


def test_reuse_and_reparse(spark):
    work = spark.range(3).withColumnRenamed("id", "k")
    ok = work.withColumn("status", F.lit("ok"))
    assert inc.reusable(ok, work, ["k"]).count() == 3
    assert inc.reusable(ok.where("k < 2"), work, ["k"]).count() == 0
    assert inc.reusable(ok.withColumn("status", F.when(F.col("k") == 1, "failed").otherwise("ok")), work, ["k"]).count() == 0
    assert inc.reusable(ok.unionByName(ok.where("k = 0")), work, ["k"]).count() == 0
    d = inc.reparsed(spark.createDataFrame([("entailed.",), ("?",)], "raw string"), "raw", lambda c: label(c, ["ENTAILED"]))
    assert sorted((r.label, r.status) for r in d.collect() if r.label) == [("ENTAILED", "ok")] and d.where("status = 'failed'").count() == 1


def test_ladder(spark):
    cases = [(None, None, "base"), ("failed", "base", "format"), ("failed", "format", "code"), ("failed", "code", None), ("ok", "base", None)]
    d = spark.createDataFrame(cases, "s string, a string, want string").withColumn("got", inc.next_attempt("s", "a"))
    assert all(r.got == r.want for r in d.collect())


def drop(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_append_stream(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "run_id string, t timestamp, elapsed double"
    drop(src, "1.json", [{"run_id": "a", "t": "2024-01-01T00:00:00Z", "elapsed": 1.5}, {"run_id": "a", "t": "2024-01-01T00:10:00Z", "elapsed": 2.0}])
    for _ in range(2):  # a restart adds nothing twice
        inc.append_samples(inc.stream_json(spark, str(src), schema), out, cp).awaitTermination()
        assert spark.read.schema(schema).json(out).count() == 2
    drop(src, "2.json", [{"run_id": "b", "t": "2024-01-01T01:00:00Z", "elapsed": 4.0}])
    inc.append_samples(inc.stream_json(spark, str(src), schema), out, cp).awaitTermination()
    d = spark.read.schema(schema).json(out)
    assert {r.run_id: (r.samples, r.elapsed) for r in inc.running_totals(d, ["run_id"], "elapsed").collect()} == {"a": (2, 3.5), "b": (1, 4.0)}


def test_upsert_stream(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "k int, v string, seq int"
    drop(src, "1.json", [{"k": 1, "v": "a", "seq": 1}, {"k": 2, "v": "b", "seq": 1}, {"k": 1, "v": "c", "seq": 3}])
    inc.upsert_stream(inc.stream_json(spark, str(src), schema), ["k"], ["seq"], out, cp).awaitTermination()
    drop(src, "2.json", [{"k": 1, "v": "old", "seq": 2}, {"k": 3, "v": "d", "seq": 1}])
    inc.upsert_stream(inc.stream_json(spark, str(src), schema), ["k"], ["seq"], out, cp).awaitTermination()
    got = {r.k: r.v for r in inc.current(spark, out, inc.stream_json(spark, str(src), schema).schema).collect()}
    assert got == {1: "c", 2: "b", 3: "d"}


def test_windowed_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    schema = "t timestamp, kind string"
    rows = [{"t": f"2024-01-01T{h:02d}:{m:02d}:00Z", "kind": "x" if m % 2 else "y"} for h in range(4) for m in range(0, 60, 7)]
    drop(src, "1.json", rows)
    q = inc.windowed_counts(inc.stream_json(spark, str(src), schema), "t", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = inc.windowed_counts(spark.read.schema(schema).json(str(src)), "t", ["kind"])
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, batch.collect()))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch whose commit was lost runs again from the state before it, and does not touch what its first run wrote."""
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    schema = "k int, v string, seq int"

    def run():
        inc.upsert_stream(inc.stream_json(spark, str(src), schema), ["k"], ["seq"], out, str(cp), buckets=3).awaitTermination()
        return {r.k: r.v for r in inc.current(spark, out, inc.stream_json(spark, str(src), schema).schema).collect()}

    drop(src, "1.json", [{"k": k, "v": "a", "seq": 1} for k in range(9)])
    assert run() == {k: "a" for k in range(9)}
    drop(src, "2.json", [{"k": 4, "v": "b", "seq": 2}, {"k": 5, "v": "late", "seq": 0}])
    want = {k: "b" if k == 4 else "a" for k in range(9)}
    assert run() == want
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    for p in (cp / "commits").glob("*1*"):
        p.unlink()
    assert run() == want
    assert {p: t for p, t in {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}.items() if p in before} == before
