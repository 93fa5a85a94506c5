"""Bootstrap intervals over clusters.

A draw gives each cluster a weight, the times it is drawn, and every estimate is
a weighted sum over clusters; there is no table of samples and clusters.

Up to ``HASHED`` clusters, numbered after sorting, are drawn by a hash of (seed,
sample, slot), so the draws are the same on every engine; tasks divide the
samples among themselves.  More clusters are dealt by hash into buckets, and
tasks divide the buckets: how many of a sample's draws fall to a bucket follows
from a tree of conditional binomials, and within the bucket the draws go to its
clusters by conditional binomials again.  Both are multinomial draws with
replacement; a task holds a few numbers for each sample.  ``numpy_ci`` repeats
numpy's generator instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.numeric import finite, index_quantile
from attestor.session import ship, stored

#: Draws of an interval: some 250 estimates lie beyond each of its bounds.
SAMPLES = 10_000
#: Clusters that are drawn by hash, and about how many share a bucket beyond.
HASHED, BUCKET = 4_096, 4_096


def draws(spark, samples: int, clusters: DataFrame, seed: int) -> DataFrame:
    """b, k: for each sample as many cluster numbers, with repetition, as there are clusters (a one-row table with column g)."""
    d = spark.range(samples).withColumnRenamed("id", "b").crossJoin(F.broadcast(clusters))
    d = d.select("b", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("x"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "b", "x"), 256), 1, 8), 16, 10).cast("long")
    return d.select("b", (h % F.col("g")).alias("k"))


def _numbered(means: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """Clusters numbered from 0 in sorted order, and their count.

    Numbering needs one task, but of one row per cluster: the table of draws,
    samples times as large, is the larger one.
    """
    n = means.withColumn("k", F.row_number().over(Window.orderBy(cluster)) - 1)
    return n, means.agg(F.count("*").alias("g"))


def cluster_means(df: DataFrame, cluster: str, values: list[str]) -> DataFrame:
    d = df.groupBy(cluster).agg(*[F.avg(finite(v)).alias(v) for v in values])
    return d.where(" AND ".join(f"{v} IS NOT NULL" for v in values))


def weighted_sums(per: DataFrame, cluster: str, columns: list[str], samples: int = SAMPLES, seed: int = 2271) -> DataFrame:
    """b, g and for each sample b the sums of ``columns`` over the g clusters drawn; ``per`` has one row for each cluster.  None without clusters."""
    spark = per.sparkSession
    ship(spark)
    d = per.select(F.col(cluster).alias("c"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"v{k}") for k, c in enumerate(columns)])
    schema = "b long, g long, " + ", ".join(f"`{c}` double" for c in columns)
    few = d.orderBy("c").limit(HASHED + 1).collect()
    if not few:
        return spark.createDataFrame([], schema)
    if len(few) <= HASHED:
        values = np.array([r[1:] for r in few], float).reshape(len(few), len(columns))
        parts = max(1, min(samples, samples * len(few) // 200_000 + 1, 64))
        return spark.range(0, samples, 1, parts).mapInArrow(_by_hash(values, seed), schema)
    d = stored(d, "clusters")
    n = d.count()
    buckets = 1 << max(0, (n // BUCKET - 1).bit_length())
    dealt = d.withColumn("p", F.pmod(F.xxhash64("c"), F.lit(buckets)))
    sizes = np.zeros(buckets, np.int64)
    for r in dealt.groupBy("p").agg(F.count("*").alias("n")).collect():  # one number for each bucket
        sizes[r.p] = r.n
    tasks = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 16))
    rows = dealt.repartition(tasks, "p").sortWithinPartitions("p", "c").drop("c").mapInArrow(_by_bucket(sizes, len(columns), samples, seed), schema)
    return rows.groupBy("b").agg(F.max("g").alias("g"), *[F.sum(F.col(f"`{c}`")).alias(c) for c in columns])


def _rows(b: np.ndarray, g: int, sums: np.ndarray, columns: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(np.full(len(b), g)), *(pa.array(sums[:, k]) for k in range(columns))], ["b", "g", *(f"v{k}" for k in range(columns))])


def _by_hash(values: np.ndarray, seed: int):
    """For batches of sample numbers the sums over clusters drawn by hash."""

    def run(batches):
        g = len(values)
        for batch in batches:
            b = batch.column(0).to_numpy()
            sums = np.empty((len(b), values.shape[1]))
            for k, sample in enumerate(b.tolist()):
                head = hashlib.sha256(f"{seed}:{sample}:".encode())
                drawn = np.empty(g, np.int64)
                for slot in range(g):
                    h = head.copy()
                    h.update(b"%d" % slot)
                    drawn[slot] = int.from_bytes(h.digest()[:4], "big")
                sums[k] = np.bincount(drawn % g, minlength=g) @ values
            yield _rows(b, g, sums, values.shape[1])

    return run


def bucket_draws(sizes: np.ndarray, bucket: int, samples: int, seed: int) -> np.ndarray:
    """How many of each sample's draws, as many as there are clusters, fall to a bucket: down a tree whose nodes split by binomials."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    n, low, high, node = np.full(samples, ends[-1]), 0, len(sizes), 1
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = ends[high] - ends[low], ends[middle] - ends[low]
        to_left = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(n, left / whole if whole else 0.0)
        if bucket < middle:
            n, high, node = to_left, middle, 2 * node
        else:
            n, low, node = n - to_left, middle, 2 * node + 1
    return n


def weights_in(n: np.ndarray, clusters: int, bucket: int, seed: int):
    """Weights of a bucket's clusters, one row of numbers for each, which add up to ``n``."""
    draw = np.random.Generator(np.random.Philox(key=[seed, (1 << 62) + bucket]))
    left = n.copy()
    for k in range(clusters):
        w = draw.binomial(left, 1.0 / (clusters - k))
        left -= w
        yield w


def _by_bucket(sizes: np.ndarray, columns: int, samples: int, seed: int):
    """For batches of clusters, sorted by bucket, the task's part of all sums."""

    def run(batches):
        at, weights, sums, block = None, None, np.zeros((samples, columns)), []
        for batch in batches:
            p = batch.column(batch.schema.get_field_index("p")).to_pylist()
            v = np.column_stack([batch.column(batch.schema.get_field_index(f"v{k}")).to_numpy() for k in range(columns)])
            for k, bucket in enumerate(p):
                if bucket != at:
                    at = bucket
                    weights = weights_in(bucket_draws(sizes, bucket, samples, seed), int(sizes[bucket]), bucket, seed)
                block.append((next(weights), v[k]))
                if len(block) == 64:
                    sums += np.array([w for w, _ in block], float).T @ np.array([x for _, x in block])
                    block = []
        if block:
            sums += np.array([w for w, _ in block], float).T @ np.array([x for _, x in block])
        if at is not None:
            yield _rows(np.arange(samples), int(sizes.sum()), sums, columns)

    return run


def estimates(df: DataFrame, cluster: str, values: list[str], samples: int = SAMPLES, seed: int = 2271) -> DataFrame:
    """b and the mean of cluster means of each value, from one set of draws."""
    d = weighted_sums(cluster_means(df, cluster, values), cluster, values, samples, seed)
    return d.select("b", *[(F.col(f"`{v}`") / F.col("g")).alias(v) for v in values])


def percentile_ci(e: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> list[Column]:
    """Aggregates: interpolated quantiles."""
    return [F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi")]


def ci(df: DataFrame, cluster: str, value: str, samples: int = SAMPLES, seed: int = 2271, interpolate: bool = True) -> DataFrame:
    """mean, lo, hi, clusters of one value; quantiles interpolated, or the element int(n * p) of the sorted estimates."""
    m = cluster_means(df, cluster, [value]).agg(F.avg(value).alias("mean"), F.count("*").alias("clusters"))
    e = estimates(df, cluster, [value], samples, seed)
    if interpolate:
        q = e.agg(*percentile_ci(e, value))
    else:
        q = e.agg(F.collect_list(value).alias("v")).select(index_quantile("v", 0.025).alias("lo"), index_quantile("v", 0.975).alias("hi"))
    return m.crossJoin(q).select("mean", "lo", "hi", "clusters")


def weighted(df: DataFrame, cluster: str, samples: int = SAMPLES, seed: int = 2271) -> DataFrame:
    """b and the rows of drawn clusters with weight w, the times drawn: any statistic of pooled rows is a weighted aggregate.

    The result has samples x rows rows: it is for statistics that no sums can
    express, on small tables; ``weighted_sums`` serves all others.
    """
    n, g = _numbered(df.select(cluster).distinct(), cluster)
    w = draws(df.sparkSession, samples, g.where("g > 0"), seed).groupBy("b", "k").agg(F.count("*").alias("w")).join(n, "k")
    return w.join(df, cluster)


def statistic_ci(df: DataFrame, cluster: str, counts: dict[str, Column], statistic, samples: int = SAMPLES, seed: int = 2271) -> DataFrame:
    """lo, hi by index quantile of a statistic of additive counts.

    Counts are summed by cluster before the draw, so rows are never repeated.
    ``statistic`` maps names to columns to one column.
    """
    per = df.groupBy(cluster).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    e = weighted_sums(per, cluster, list(counts), samples, seed)
    e = e.select("b", statistic({n: F.col(n) for n in counts}).alias("s"))
    q = e.agg(F.collect_list("s").alias("v"))
    return q.select(index_quantile("v", 0.025).alias("lo"), index_quantile("v", 0.975).alias("hi"))


def numpy_ci(df: DataFrame, cluster: str, value: str, samples: int = SAMPLES, seed: int = 2271, most: int = 100_000) -> dict:
    """mean, lo, hi, clusters with numpy's PCG64 draws, on the driver; more than ``most`` clusters raise."""
    d = cluster_means(df, cluster, [value]).orderBy(cluster)
    rows = d.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters; use ci()")
    if not rows:
        return {"mean": None, "lo": None, "hi": None, "clusters": 0}
    v, rng, e = np.array([r[value] for r in rows]), np.random.default_rng(seed), np.empty(samples)
    step = max(1, 4_000_000 // len(v))  # some 32 MB of draws at a time; the generator goes on where it was
    for k in range(0, samples, step):
        e[k : k + step] = v[rng.integers(0, len(v), size=(min(step, samples - k), len(v)))].mean(1)
    return {"mean": float(v.mean()), "lo": float(np.quantile(e, 0.025)), "hi": float(np.quantile(e, 0.975)), "clusters": len(v)}
