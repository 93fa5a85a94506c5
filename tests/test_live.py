"""Live state against plain loops, restarts included; polling until a run ends."""

import random
import threading
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attestor.plans import streams
from attestor.streaming import incremental, live

START = datetime(2024, 1, 1)


def batches(spark, rows, schema, path, n):
    """Files of n micro-batches, in order of time, each written after the one before."""
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_retries_equal_a_loop_across_restarts(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"i{k % 12}", START + timedelta(seconds=draw.randrange(7_000)), draw.choice(["ok", "parse_failed", "parse_failed", "parse_failed"])) for k in range(60)]
    rows.append(("clock", START + timedelta(seconds=20_000), "parse_failed"))
    for stream in batches(spark, rows, "item string, ts timestamp, status string", f"{tmp_path}/in", 3):
        live.run_to_end(live.retries(stream, "600 seconds", "1 second"), ["item"], f"{tmp_path}/state", f"{tmp_path}/checkpoint")  # a new query each time
    found = {r.item: (r.attempts, r.attempt, r.status) for r in incremental.current(spark, f"{tmp_path}/state", live.RETRIES + ", _epoch long").collect()}
    for item in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == item)
        attempts, step, status, deadline = 0, 0, "pending", own[0][0] + timedelta(seconds=600)
        for at, outcome in [*own, (START + timedelta(seconds=19_999), None)]:  # the last watermark
            while status == "pending" and (at > deadline or outcome is None and at >= deadline):
                attempts += 1
                status, step, deadline = ("timed out", step, deadline) if step == 2 else ("pending", step + 1, deadline + timedelta(seconds=600))
            if status == "pending" and outcome is not None:
                attempts += 1
                if outcome == "ok":
                    status = "ok"
                elif step == 2:
                    status = "exhausted"
                else:
                    step, deadline = step + 1, at + timedelta(seconds=600)
        assert found[item] == (attempts, incremental.LADDER[step] if status == "pending" else None, status), item
    assert {s for *_, s in found.values()} >= {"ok", "pending", "timed out"}


def test_items_share_groups_of_the_state(spark, tmp_path):
    draw = random.Random(5)
    rows = [(None if k % 30 == 0 else f"i{k % 30}", START + timedelta(seconds=draw.randrange(3_000)), draw.choice(["ok", "x", "x", None])) for k in range(75)]
    rows += [("clock", START + timedelta(seconds=s), "x") for s in (3_001, 9_000, 20_000)]
    for stream in batches(spark, rows, "item string, ts timestamp, status string", f"{tmp_path}/in", 3):
        live.run_to_end(live.retries(stream, "600 seconds", "1 second", buckets=4), ["item"], f"{tmp_path}/state", f"{tmp_path}/checkpoint")
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() <= 4  # not one for each item
    found = {r.item: (r.attempts, r.attempt, r.status) for r in incremental.current(spark, f"{tmp_path}/state", live.RETRIES + ", _epoch long").collect()}
    assert set(found) == {r[0] for r in rows}
    for item in found:
        own = sorted((int((r[1] - START).total_seconds()), r[2] or "x") for r in rows if r[0] == item)
        now = (0, 0, "pending", own[0][0] + 600)
        for at, status in own:
            now = live.advanced(now, status, at, 600)
        while now[2] == "pending" and now[3] < 19_999:  # the last watermark
            now = live.advanced(now, None, now[3], 600)
        assert found[item] == (now[0], incremental.LADDER[now[1]] if now[2] == "pending" else None, now[2]), item


def test_rows_of_a_part_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    d = spark.range(0, 90, 1, 4).selectExpr("cast(id % 5 as string) AS run", "timestamp_seconds(id * 37 % 90) AS ts", "cast(id * 37 % 90 AS double) AS elapsed")
    found = {r.run: (r.samples, r.elapsed) for r in streams._final(d, live.progress, "run", live.PROGRESS, "p").collect()}
    assert found == {str(k): (18, max(float(i * 37 % 90) for i in range(90) if i % 5 == k)) for k in range(5)}
    assert len(list((tmp_path / "p-rows").glob("*.parquet"))) == 12  # 3 parts of 4 tasks


def test_progress_over_restarts(spark, tmp_path):
    rows, clock = [], 0.0
    for k in range(40):
        clock = 0.5 if k % 11 == 10 else clock + 1.25
        rows += [("a", START + timedelta(seconds=k), clock), ("b", START + timedelta(seconds=k), float(k))]
    for stream in batches(spark, rows, "run string, ts timestamp, elapsed double", f"{tmp_path}/in", 4):
        live.run_to_end(live.progress(stream), ["run"], f"{tmp_path}/state", f"{tmp_path}/checkpoint")
    found = {r.run: (r.samples, r.elapsed, r.restarts, r.peak) for r in incremental.current(spark, f"{tmp_path}/state", live.PROGRESS + ", _epoch long").collect()}
    a = [r[2] for r in rows if r[0] == "a"]
    spent = sum(x for x, y in zip(a, [*a[1:], 0.0]) if y < x)
    assert found == {"a": (40, spent, 3, max(a)), "b": (40, 39.0, 0, 39.0)}


def test_runs_share_groups_of_the_state(spark, tmp_path):
    draw = random.Random(7)
    rows = [(None if k % 25 == 0 else f"r{k % 25}", START + timedelta(seconds=k), float(draw.randrange(50))) for k in range(150)]
    for stream in batches(spark, rows, "run string, ts timestamp, elapsed double", f"{tmp_path}/in", 3):
        live.run_to_end(live.progress(stream, buckets=4), ["run"], f"{tmp_path}/state", f"{tmp_path}/checkpoint")
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() <= 4  # not one for each run
    found = {r.run: (r.samples, r.elapsed, r.restarts, r.peak) for r in incremental.current(spark, f"{tmp_path}/state", live.PROGRESS + ", _epoch long").collect()}
    want = {}
    for run in {r[0] for r in rows}:
        own = [r[2] for r in rows if r[0] == run]
        back = [x for x, y in zip(own, own[1:]) if y < x]
        want[run] = (len(own), sum(back) + own[-1], len(back), max(own))
    assert found == want


def test_watch_until_the_run_ends(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()

    def work():
        for k in range(4):
            with open(run / "progress", "a") as f:
                f.write("x" * 10)
            time.sleep(1)
        (run / "exit").write_text("0")

    t = threading.Thread(target=work)
    t.start()
    assert live.watch(spark, f"file://{run}", "r1", f"{tmp_path}/out", f"{tmp_path}/checkpoint", "500 milliseconds", most=120)
    t.join()
    rows = spark.read.json(f"{tmp_path}/out").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1)) and [r.ended for r in rows] == [False] * (len(rows) - 1) + [True]
    sizes = [r.progress_bytes or 0 for r in rows]
    assert sizes == sorted(sizes) and sizes[-1] == 40
    assert live.watch(spark, f"file://{run}", "r1", f"{tmp_path}/out", f"{tmp_path}/checkpoint", "500 milliseconds", most=8) in (True, False)
    assert spark.read.json(f"{tmp_path}/out").count() == len(rows)  # an ended run gives no further sample


def test_a_batch_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        seen.add(1)
        return v

    rows = spark.range(20).select(counted("id").alias("k"), F.col("id").alias("v"))
    incremental.merge_batch(rows, 0, ["k"], ["v"], f"{tmp_path}/state", 4)
    assert incremental.current(spark, f"{tmp_path}/state", "k long, v long").count() == 20
    assert seen.value == 20


def test_state_does_not_grow_with_batches(spark, tmp_path):
    schema, path = "k long, v long", f"{tmp_path}/state"
    for epoch in range(12):
        batch = spark.createDataFrame([(epoch % 3, epoch), (50 + epoch, epoch)], schema)
        incremental.merge_batch(batch, epoch, ["k"], ["v"], path, 4)
        if epoch == 10:
            incremental.merge_batch(batch, epoch, ["k"], ["v"], path, 4)  # repeated
    found = {r.k: r.v for r in incremental.current(spark, path, schema).collect()}
    assert found == {0: 9, 1: 10, 2: 11, **{50 + e: e for e in range(12)}}
    marks = incremental._listed(spark, f"{path}/marks")
    assert len(marks) <= 2 * incremental.KEPT_MARKS
    named = {b.split("/")[-2] for b in incremental._all_buckets(spark, path, marks)}
    folders = [f for f in incremental._listed(spark, path) if f.startswith("v")]
    assert len(folders) <= len(named) + 2 * incremental.KEPT_MARKS
