"""Small models: ridge by normal equations, clusters of directions per group, listwise losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.numeric import col
from attestor.functions.vectors import bound, log_softmax


def gram(df: DataFrame, vector: str, target: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, and the sums of [x, y] and of its outer product, added up in parts: (width + 1)^2 numbers, however many rows."""
    w = width + 1

    def run(batches):
        n, total, outer = 0, np.zeros(w), np.zeros((w, w))
        for b in batches:
            x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            z = np.column_stack((x, b.column(1).to_numpy(zero_copy_only=False)))
            n, total, outer = n + len(z), total + z.sum(0), outer + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([float(n)])], ["k", "v"])
        flat = np.concatenate((total, outer.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, 1 + len(flat))), pa.array(flat)], ["k", "v"])

    d = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = d.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    v = np.zeros(1 + w + w * w)
    v[rows["k"].to_numpy()] = rows["v"].to_numpy()
    return int(v[0]), v[1 : 1 + w], v[1 + w :].reshape(w, w)


def ridge(df: DataFrame, vector: str, target: str, width: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, scale and weights (bias last) of ridge on standardised features.

    The scale is the sample deviation, at least 1e-6; the bias is penalised
    too and the penalty is not divided by n.
    """
    n, total, outer = gram(df, vector, target, width)
    mean = total[:width] / n
    scale = np.maximum(np.sqrt(np.maximum((np.diag(outer)[:width] - n * mean**2) / (n - 1), 0)), 1e-6)
    xx = (outer[:width, :width] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    xy = (outer[:width, width] - mean * total[width]) / scale
    a = np.zeros((width + 1, width + 1))
    a[:width, :width] = xx
    a[width, width] = n
    return mean, scale, np.linalg.solve(a + penalty * np.eye(width + 1), np.append(xy, total[width]))


def ridge_score(vector: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """A model's score as one linear expression over the vector."""
    mean, scale, w = model
    slope = w[:-1] / scale
    bias = float(w[-1] - (slope * mean).sum())
    return F.aggregate(F.zip_with(col(vector), F.lit([float(x) for x in slope]), lambda x, y: x.cast("double") * y), F.lit(bias), lambda a, x: a + x)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)


def _farthest_rows(points: np.ndarray, k: int) -> np.ndarray:
    """Row 0, then again and again the row whose best similarity to the rows taken is lowest (the first of equals)."""
    taken, best = [0], points @ points[0]
    while len(taken) < min(k, len(points)):
        taken.append(int(np.argmin(best)))
        np.maximum(best, points @ points[taken[-1]], out=best)
    return np.array(taken)


def directions(vectors: np.ndarray, k: int = 5, rounds: int = 20) -> np.ndarray:
    """The cluster of each vector by direction: k-means on the unit sphere from farthest-first seeds.

    A cluster that loses its last vector stays where it was; fewer vectors than
    ``k`` make as many clusters; no vector, no label.
    """
    if not len(vectors):
        return np.zeros(0, np.int64)
    points = _unit(np.asarray(vectors, float))
    heads = points[_farthest_rows(points, k)]
    nearest = np.argmax(points @ heads.T, axis=1)
    for _ in range(rounds - 1):
        sums = np.zeros_like(heads)
        np.add.at(sums, nearest, points)
        full = np.bincount(nearest, minlength=len(heads)) > 0
        heads[full] = _unit(sums[full])
        moved = np.argmax(points @ heads.T, axis=1)
        if (moved == nearest).all():
            break
        nearest = moved
    return nearest


def direction_clusters(df: DataFrame, group: str, order: str, vector: str, clusters: int = 5) -> DataFrame:
    """group, order, cluster for the vectors of each group (the patches of one image: a bounded number)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        labels = directions(np.array(t[vector].to_pylist(), float), clusters)
        return pa.table({group: t[group], order: t[order], "cluster": pa.array(labels, pa.int32())})

    kinds = dict(df.dtypes)
    return df.select(group, order, vector).groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, cluster int")


def listwise_loss(logits, positive, valid) -> Column:
    """Cross entropy to the uniform distribution over the positive places: minus the mean of their log-softmax; null without one."""
    p = F.zip_with(log_softmax(logits, valid), F.zip_with(col(positive), col(valid), lambda y, m: y & m), lambda x, y: F.when(y, x))
    return bound(F.array_compact(p), lambda x: F.when(F.size(x) > 0, -F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x)))


def symmetric_kl(left, right, valid) -> Column:
    """Mean of both Kullback-Leibler divergences of two masked softmaxes."""
    p = F.zip_with(log_softmax(left, valid), log_softmax(right, valid), lambda x, y: F.coalesce((F.exp(x) - F.exp(y)) * (x - y), F.lit(0.0)))
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / 2.0


def scored(df: DataFrame, scorer, columns: list[str], schema: str) -> DataFrame:
    """Apply an injected scorer (iterator of Arrow batches to iterator of batches) to distinct inputs, and join back.

    Equal inputs are scored once.
    """
    once = df.select(*columns).distinct().mapInArrow(scorer, schema)
    return df.join(once, columns)


def shuffled_features(df: DataFrame, key: str, owner: str, vector: str, seed: int = 0, bucket_rows: int = 4_096) -> DataFrame:
    """Control: each row gets the vector of the next owner in hash order.

    Owners are windowed within hash buckets of about ``bucket_rows``; the last
    of a bucket is followed by the first of the next bucket that has owners, so
    only a table of one owner gives that owner's own vector.
    """
    from pyspark.sql import Window

    per = df.groupBy(owner).agg(F.min_by(vector, key).alias("_v"))
    buckets = per.count() // bucket_rows + 1
    per = per.withColumn("_b", F.pmod(F.xxhash64(owner, F.lit(seed + 1)), F.lit(buckets)))
    per = per.withColumn("_o", F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(owner).cast("string")), 256), F.col(owner)))
    # one row for each bucket: its successor's first vector
    heads = per.groupBy("_b").agg(F.min_by("_v", "_o").alias("_first"))
    ring = Window.orderBy("_b")
    around = F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_b", F.coalesce(F.lead("_first").over(ring), around).alias("_first"))
    nxt = F.coalesce(F.lead("_v").over(Window.partitionBy("_b").orderBy("_o")), F.col("_first"))
    return df.join(per.join(heads, "_b").select(owner, nxt.alias("shuffled")), owner)
