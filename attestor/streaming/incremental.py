"""Resumable work: pending rows, guards, retries, re-parsing, and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.numeric import col
from attestor.operators.joins import pending
from attestor.session import removed
from attestor.sources.io import exists


class Run:
    """A run's results in a folder, guarded by the fingerprint of its settings."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str, schema: str):
        self.spark, self.path, self.fingerprint, self.schema = spark, path, fingerprint, schema
        mark = f"{path}/run"
        if exists(spark, mark):
            found = spark.read.json(mark).first()["fingerprint"]
            if found != fingerprint:
                raise ValueError(f"{path} holds another run: {found}")
        else:
            spark.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.json(mark)

    def done(self) -> DataFrame:
        at = f"{self.path}/rows"
        return self.spark.read.schema(self.schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], self.schema)

    def pending(self, work: DataFrame, keys: list[str]) -> DataFrame:
        return pending(work, self.done(), keys)

    def step(self, work: DataFrame, keys: list[str], process, limit: int | None = None) -> int:
        """Process what is pending, append the results, and return how many rows are left pending.

        The append is atomic; a step that is lost is simply pending again.
        """
        todo = self.pending(work, keys)
        todo = todo.orderBy(*keys).limit(limit) if limit else todo
        process(todo).select(*[f.name for f in self.done().schema]).write.mode("append").parquet(f"{self.path}/rows")
        return self.pending(work, keys).count()


#: Attempts in the order in which they are made.
LADDER = ["base", "format", "code"]


def next_attempt(status, attempt) -> Column:
    """The attempt to make next: none after success or the last one; the first for new rows."""
    out = F.when(col(status) == "ok", None).when(col(attempt).isNull(), LADDER[0])
    for a, b in zip(LADDER, LADDER[1:]):
        out = out.when(col(attempt) == a, b)
    return out


def reusable(cache: DataFrame, work: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The cached rows if they are exactly the work's keys and all are ok; else none."""
    a, b = cache.select(*keys), work.select(*keys)
    odd = a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count() + cache.where(~F.coalesce(F.col(status) == "ok", F.lit(False))).limit(1).count()
    return cache.where(F.lit(odd == 0))


def reparsed(cache: DataFrame, raw: str, parser) -> DataFrame:
    """Labels and statuses derived again from stored raw output, without asking again."""
    return cache.withColumn("label", parser(F.col(raw))).withColumn("status", F.when(F.col("label").isNotNull(), "ok").otherwise("failed"))


def stream_json(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def append_samples(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append-only sink of monitor samples."""
    w = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def upsert_stream(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64):
    """Keep the last row of each key in a state of hash buckets; a micro-batch rewrites the buckets that it touches."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, keys, order, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Marks that are kept: a repeated batch needs the one before it, a reader the one it has just read.
KEPT_MARKS = 3


def merge_batch(batch: DataFrame, epoch: int, keys: list[str], order: list[str], path: str, buckets: int = 64) -> None:
    """Merge a micro-batch into the state under ``path``.

    Each batch writes to a folder of its own, then a mark that names the folder
    of every bucket.  A batch that is repeated starts from the mark of the batch
    before it and leaves the folders of its first attempt alone.  Marks older
    than the last ``KEPT_MARKS`` go, and with them the folders that only they name,
    so neither files nor the time of a batch grow with the number of batches.
    """
    from attestor.operators.sampling import last_wins

    schema = batch.schema
    spark, at = batch.sparkSession, _marks(batch.sparkSession, path, epoch)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch = batch.persist()
    try:
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        old = [at[str(b)] for b in touched if str(b) in at]
        state = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
        new = f"{path}/v{epoch}-{uuid.uuid4().hex}"
        merged = last_wins(state.unionByName(batch), keys, order).withColumn("_bucket", bucket)
        merged.write.partitionBy("_bucket").parquet(new)
    finally:
        batch.unpersist()
    at |= {str(b): f"{new}/_bucket={b}" for b in touched}
    mark = json.dumps({"epoch": epoch, "buckets": at})
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}/marks/{epoch:012d}-{uuid.uuid4().hex}")
    _trimmed(spark, path)


def _listed(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _trimmed(spark: SparkSession, path: str) -> None:
    """Delete old marks and the folders that none of the others names."""
    marks = _listed(spark, f"{path}/marks")
    if len(marks) <= 2 * KEPT_MARKS:  # now and then is enough
        return
    keep = marks[-KEPT_MARKS:]
    named = {b.removeprefix(path + "/").split("/")[0] for b in _all_buckets(spark, path, keep)}
    for m in marks[:-KEPT_MARKS]:
        removed(spark, f"{path}/marks/{m}")
    newest = max(int(m.split("-")[0]) for m in keep)
    for folder in _listed(spark, path):
        if folder.startswith("v") and folder not in named and int(folder[1:].split("-")[0]) < newest:
            removed(spark, f"{path}/{folder}")


def _all_buckets(spark: SparkSession, path: str, marks: list[str]) -> list[str]:
    rows = spark.read.text([f"{path}/marks/{m}" for m in marks]).select(F.from_json("value", "epoch long, buckets map<string,string>").alias("m"))
    return [x for r in rows.collect() for x in r.m.buckets.values()]  # at most KEPT_MARKS x buckets names


def _marks(spark: SparkSession, path: str, before: int | None = None) -> dict[str, str]:
    """The folder of each bucket by the last whole mark, or the last one of a batch before ``before``."""
    marks = [m for m in _listed(spark, f"{path}/marks") if before is None or int(m.split("-")[0]) < before]
    if not marks:
        return {}
    last = marks[-1].split("-")[0]  # a repeated batch leaves several marks, of which the latest counts
    rows = spark.read.text([f"{path}/marks/{m}" for m in marks if m.split("-")[0] == last]).select(F.from_json("value", "epoch long, buckets map<string,string>").alias("m"), F.col("_metadata.file_modification_time").alias("t"))
    found = rows.orderBy(F.desc("t")).select("m.buckets").first()
    return dict(found[0]) if found else {}


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    at = _marks(spark, path)
    return spark.read.schema(schema).parquet(*at.values()) if at else spark.createDataFrame([], schema)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window; rows later than the watermark are dropped by the stream."""
    d = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return d.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def running_totals(stream: DataFrame, keys: list[str], elapsed: str) -> DataFrame:
    """Progress across restarts: samples, greatest progress and summed time of each run."""
    return stream.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum(elapsed).alias("elapsed"))
