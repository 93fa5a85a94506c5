"""Keyed state that lives as long as a stream: retries with deadlines, progress across restarts, and polling until a run ends."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from attestor.session import ship
from attestor.streaming.incremental import LADDER

RETRIES = "item string, attempts long, attempt string, status string"
_RETRY_STATE = "items array<string>, attempts array<long>, steps array<long>, statuses array<string>, deadlines array<long>"
PROGRESS = "run string, samples long, elapsed double, restarts long, peak double"
_PROGRESS_STATE = "runs array<string>, samples array<long>, carried array<double>, last array<double>, restarts array<long>, peaks array<double>"

#: Groups of the state, fixed for the life of a stream: a group costs Python milliseconds in each
#: micro-batch that touches it, so keys share groups by hash and each has its own entry there.
BUCKETS = 1024


def _by_bucket(rows: DataFrame, key: str, buckets: int):
    key_text = F.col(key).cast("string")
    return rows.withColumn(key, key_text).withColumn("_bucket", F.pmod(F.xxhash64(key_text), F.lit(buckets))).groupBy("_bucket")


def _held(state) -> dict[str | None, tuple]:
    """A group's entries by key, from parallel arrays of which the first holds the keys."""
    if not state.exists:
        return {}
    keys, *columns = state.get
    return dict(zip(keys, zip(*columns)))


def _keep(state, held: dict[str | None, tuple]) -> None:
    state.update((list(held), *map(list, zip(*held.values()))))


def advanced(state: tuple, status: str | None, at: int, patience: int) -> tuple:
    """(attempts, step, status, deadline) after an outcome at ``at`` (ms); a null status is an attempt that timed out.

    Deadlines that passed before the outcome count first, so the state does not
    depend on where micro-batches were cut.
    """
    attempts, step, now, deadline = state
    while now == "pending" and status is not None and at > deadline:
        attempts, step, now, deadline = advanced((attempts, step, now, deadline), None, deadline, patience)
    if now != "pending":
        return attempts, step, now, deadline
    if status == "ok":
        return attempts + 1, step, "ok", at
    if step + 1 == len(LADDER):
        return attempts + 1, step, "exhausted" if status is not None else "timed out", at
    return attempts + 1, step + 1, "pending", at + patience


def _retry_row(item: str, state: tuple) -> dict:
    return {"item": item, "attempts": state[0], "attempt": LADDER[state[1]] if state[2] == "pending" else None, "status": state[2]}


def retries(outcomes: DataFrame, patience: str = "10 minutes", late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """The retry ladder as live state: for each item its attempts, the attempt to make next, and its status.

    ``outcomes`` has item, ts and status ('ok' or a failure).  An attempt without
    an outcome within ``patience`` of the one before has timed out; a timer,
    driven by the watermark, notices it without a further row.  Rows are taken in
    the order of ts within a micro-batch.  State is in the checkpoint, so a
    restarted stream goes on where it was; items share ``buckets`` groups of it.
    """
    import pandas as pd

    spark = outcomes.sparkSession
    ship(spark)
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key, frames, state):
        held, found, mark = _held(state), {}, state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat(frames).sort_values(["ts", "status"])
            times = rows["ts"].astype("datetime64[ms]").astype("int64").tolist()
            for item, at, status in zip(rows["item"].tolist(), times, rows["status"].tolist()):
                now = held[item] if item in held else (0, 0, "pending", at + wait)
                held[item] = found[item] = advanced(now, status or "failed", at, wait)
        for item, now in held.items():
            while now[2] == "pending" and now[3] < mark:
                now = found[item] = advanced(now, None, now[3], wait)
        held |= found
        _keep(state, held)
        pending = [now[3] for now in held.values() if now[2] == "pending"]
        if pending:
            state.setTimeoutTimestamp(max(min(pending), mark + 1))
        if found:
            yield pd.DataFrame([_retry_row(item, now) for item, now in found.items()])

    d = _by_bucket(outcomes.withWatermark("ts", late).select("item", "ts", "status"), "item", buckets)
    return d.applyInPandasWithState(step, RETRIES, _RETRY_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def progressed(state: tuple, elapsed: float) -> tuple:
    """(samples, carried, last, restarts, peak) after a sample; a clock that goes back has been restarted."""
    samples, carried, last, restarts, peak = state
    again = elapsed < last
    return samples + 1, carried + last if again else carried, elapsed, restarts + again, max(peak, elapsed)


def progress(samples: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """For each run the samples so far, the time spent over all its restarts, their number, and the longest stretch.

    ``samples`` has run, ts and elapsed, the time since the run's last start.
    Runs share ``buckets`` groups of the state.
    """
    import pandas as pd

    ship(samples.sparkSession)

    def step(key, frames, state):
        held, found = _held(state), {}
        rows = pd.concat(frames).sort_values(["ts", "elapsed"])
        for run, elapsed in zip(rows["run"].tolist(), rows["elapsed"].tolist()):
            now = held[run] if run in held else (0, 0.0, 0.0, 0, 0.0)
            held[run] = found[run] = progressed(now, float(elapsed))
        _keep(state, held)
        yield pd.DataFrame([{"run": run, "samples": n, "elapsed": carried + last, "restarts": restarts, "peak": peak} for run, (n, carried, last, restarts, peak) in found.items()])

    d = _by_bucket(samples.select("run", "ts", "elapsed"), "run", buckets)
    return d.applyInPandasWithState(step, PROGRESS, _PROGRESS_STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Work off what a stream has now and keep the last row of each key under ``path`` (read it with ``incremental.current``)."""
    from attestor.streaming.incremental import merge_batch

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch.withColumn("_epoch", F.lit(epoch).cast("long")), epoch, keys, ["_epoch"], path, 8)

    q = stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class _Watched(SimpleDataSourceStreamReader):
    """One sample of a run's progress file for each trigger; an offset carries its sample, so replayed batches are the same."""

    def __init__(self, options):
        self.path, self.run = options["path"], options.get("run", "")

    def initialOffset(self):
        return {"n": 0, "at": 0.0, "size": -1, "mtime": -1.0, "ended": False}

    def _sample(self, n: int) -> dict:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        log, end = files.get_file_info([f"{root}/progress", f"{root}/exit"])
        known = log.type == fs.FileType.File
        return {"n": n, "at": time.time(), "size": log.size if known else -1, "mtime": log.mtime_ns / 1e9 if known else -1.0, "ended": end.type == fs.FileType.File}

    def _row(self, o: dict):
        return (self.run, o["n"], o["at"], None if o["size"] < 0 else o["size"], None if o["mtime"] < 0 else o["mtime"], o["ended"])

    def read(self, start):
        if start["ended"]:
            return iter(()), start
        now = self._sample(start["n"] + 1)
        return iter([self._row(now)]), now

    def readBetweenOffsets(self, start, end):
        return iter([] if start["n"] == end["n"] else [self._row(end)])

    def commit(self, end):
        pass


class WatchedRun(DataSource):
    """Streaming source ``watched_run``: option path, a folder with a file ``progress`` that grows and a file ``exit`` once the run has ended."""

    @classmethod
    def name(cls):
        return "watched_run"

    def schema(self):
        return "run string, n long, at double, progress_bytes long, progress_mtime double, ended boolean"

    def simpleStreamReader(self, schema):
        return _Watched(self.options)


class _UntilEnded(StreamingQueryListener):
    """Sets an event when the watched source's offset says that the run has ended."""

    def __init__(self, name: str):
        self.name, self.ended = name, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name and any(json.loads(s.endOffset or "{}").get("ended") for s in p.sources):
            self.ended.set()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def watch(spark: SparkSession, path: str, run: str, out: str, checkpoint: str, interval: str = "5 seconds", most: float | None = None) -> bool:
    """Append a sample of a run to ``out`` (JSON lines) at each interval until the run has ended; False if ``most`` seconds passed before.

    The sample that sees the end is the last one.  A watch that was broken off
    goes on from its checkpoint.
    """
    ship(spark)
    spark.dataSource.register(WatchedRun)
    listener = _UntilEnded(f"watch-{run}")
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.format("watched_run").option("path", path).option("run", run).load()
        q = rows.writeStream.queryName(listener.name).format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
        limit = None if most is None else time.monotonic() + most
        while not listener.ended.wait(0.2) and q.isActive and (limit is None or time.monotonic() < limit):
            pass
        if q.exception():
            raise q.exception()
        q.stop()
        return listener.ended.is_set()
    finally:
        spark.streams.removeListener(listener)
