"""Bootstrap by weights: sums against loops, moments of the draws, and many clusters."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import resample


def test_hashed_draws_against_a_loop(spark):
    values = {f"c{k}": float(k * k) for k in range(7)}
    d = spark.createDataFrame(list(values.items()), "c string, v double")
    v, g = [values[k] for k in sorted(values)], len(values)
    found = {r.b: r.v for r in resample.estimates(d, "c", ["v"], samples=50, seed=3).collect()}
    drawn = lambda b, x: int(hashlib.sha256(f"3:{b}:{x}".encode()).hexdigest()[:8], 16) % g
    assert found == pytest.approx({b: sum(v[drawn(b, x)] for x in range(g)) / g for b in range(50)})


def test_weights_are_multinomial():
    """Weights of all buckets add up to the number of clusters, each with mean 1, variance 1 - 1/g and covariance -1/g."""
    sizes, samples = np.array([3, 0, 5, 4]), 40_000
    per = [np.array(list(resample.weights_in(resample.bucket_draws(sizes, k, samples, 9), int(n), k, 9))).reshape(n, samples) for k, n in enumerate(sizes)]
    w = np.concatenate(per).astype(float)
    assert (w.sum(0) == 12).all()
    expected = np.eye(12) - 1 / 12
    assert np.abs(w.mean(1) - 1).max() < 0.03 and np.abs(np.cov(w) - expected).max() < 0.04


def test_buckets_against_their_weights(spark, monkeypatch):
    monkeypatch.setattr(resample, "HASHED", 50)
    monkeypatch.setattr(resample, "BUCKET", 32)
    d = spark.range(500).select(F.col("id").alias("c"), (F.col("id") % 37).cast("double").alias("x"), F.lit(1).alias("one"))
    found = resample.weighted_sums(d, "c", ["x", "one"], samples=300, seed=5).orderBy("b").collect()
    assert [r.b for r in found] == list(range(300)) and all(r.g == r.one == 500 for r in found)
    again = resample.weighted_sums(d.repartition(7), "c", ["x", "one"], samples=300, seed=5).orderBy("b").collect()
    assert [r.x for r in again] == pytest.approx([r.x for r in found])
    e = np.array([r.x / 500 for r in found])
    v = np.arange(500) % 37
    assert abs(e.mean() - v.mean()) < 0.1 and abs(e.std() - v.std() / 500**0.5) < 0.06


def test_many_clusters_make_no_pairs(spark):
    """60,000 clusters x 1,000 samples: no row of the plan stands for a cluster and a sample."""
    d = spark.range(60_000).select(F.col("id").alias("c"), (F.col("id") % 101).cast("double").alias("v"))
    e = resample.estimates(d, "c", ["v"], samples=1_000)
    plan = e._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan and "Window" not in plan
    x = np.array([r.v for r in e.collect()])
    assert len(x) == 1_000 and abs(x.mean() - 49.99) < 0.02 and abs(x.std() - 29.15 / 60_000**0.5) < 0.015


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "c long, v double")
    assert resample.weighted_sums(none, "c", ["v"], samples=10).count() == 0
