"""Queries shaped like streams, over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.plans.registry import query
from attestor.session import scratch
from attestor.streaming import incremental, live


@query("tumbling_event_counts", """
SELECT date_trunc('hour', ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_event_counts(t):
    d = incremental.windowed_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour")
    return d.select(F.col("window.start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@query("session_activity", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def session_activity(t):
    d = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = d.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("running_progress", """
SELECT user_id, count(*) AS samples, CAST(max(run) AS BIGINT) AS total, CAST(max(peak) AS BIGINT) AS peak FROM (SELECT user_id, sum(CAST(props->>'$.k' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, max(CAST(props->>'$.k' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events) GROUP BY 1""")
def running_progress(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.from_json("props", "k long")["k"]
    d = t("events").select("user_id", F.sum(k).over(w).alias("run"), F.max(k).over(w).alias("peak"))
    return d.groupBy("user_id").agg(F.count("*").alias("samples"), F.max("run").alias("total"), F.max("peak").alias("peak"))


@query("retry_ladder", """
WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) % 3 AS c FROM events)
SELECT CASE WHEN event_type = 'click' THEN NULL WHEN c = 0 THEN 'format' WHEN c = 1 THEN 'code' ELSE NULL END AS next_attempt, count(*) AS n FROM a WHERE rn = 1 GROUP BY 1""")
def retry_ladder(t):
    from attestor.operators.sampling import last_wins

    e = t("events")
    d = last_wins(e, ["user_id"], ["ts", "event_id"]).join(e.groupBy("user_id").agg((F.count("*") % 3).cast("int").alias("c")), "user_id")
    d = d.select(F.when(F.col("event_type") == "click", "ok").otherwise("failed").alias("status"), F.get(F.lit(incremental.LADDER), "c").alias("attempt"))
    return d.groupBy(incremental.next_attempt("status", "attempt").alias("next_attempt")).agg(F.count("*").alias("n"))


def _in_batches(d, cuts: int = 3):
    """The rows in order of ts, as many parts as there are cuts."""
    ends = d.agg(F.percentile_approx("ts", [k / cuts for k in range(1, cuts)]).alias("q")).first().q or []
    for low, high in zip([None, *ends], [*ends, None]):
        part = d if low is None else d.where(F.col("ts") > F.lit(low))
        yield part if high is None else part.where(F.col("ts") <= F.lit(high))


def _final(d, operator, key: str, schema: str, name: str):
    """The last row of each key when all rows are worked off.

    The stream goes on from its checkpoint whenever the next rows are there, so
    a micro-batch is all the files of one part, however many tasks write them.
    """
    spark = d.sparkSession
    path, state, checkpoint = (scratch(spark, f"{name}{end}") for end in ("-rows", "", "-checkpoint"))
    for part in _in_batches(d):
        part.write.mode("append").parquet(path)
        live.run_to_end(operator(spark.readStream.schema(d.schema).parquet(path)), [key], state, checkpoint)
    return incremental.current(spark, state, schema + ", _epoch long")


@query("live_progress", """
WITH k AS (SELECT user_id, CAST(props->>'$.k' AS DOUBLE) AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(props->>'$.k' AS DOUBLE)) AS i FROM events),
n AS (SELECT *, lead(e) OVER (PARTITION BY user_id ORDER BY i) AS next FROM k)
SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS samples, sum(e) FILTER (WHERE next IS NULL OR next < e) AS elapsed, count(*) FILTER (WHERE next < e) AS restarts, max(e) AS peak FROM n GROUP BY 1""")
def live_progress(t):
    """Progress of each user's clock, which goes back at restarts, as state of a stream."""
    d = t("events").select(F.col("user_id").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.from_json("props", "k double")["k"].alias("elapsed"))
    return _final(d, live.progress, "run", live.PROGRESS, "progress").select("run", "samples", "elapsed", "restarts", "peak")


@query("live_retries", """
WITH e AS (SELECT user_id, event_type = 'click' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'click' THEN 'ok' ELSE 'x' END) AS i FROM events),
u AS (SELECT user_id, count(*) AS n, min(i) FILTER (WHERE ok) AS p FROM e GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS item, least(n, coalesce(p, 3), 3) AS attempts, CASE WHEN p <= 3 OR n >= 3 THEN NULL WHEN n = 1 THEN 'format' ELSE 'code' END AS attempt, CASE WHEN p <= 3 THEN 'ok' WHEN n >= 3 THEN 'exhausted' ELSE 'pending' END AS status FROM u""")
def live_retries(t):
    """Each user's events as outcomes of attempts, as state of a stream; nothing times out."""
    status = F.when(F.col("event_type") == "click", "ok").otherwise("x")
    d = t("events").select(F.col("user_id").cast("string").alias("item"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    return _final(d, lambda stream: live.retries(stream, "10000 days"), "item", live.RETRIES, "retries").select("item", "attempts", "attempt", "status")
