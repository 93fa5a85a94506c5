"""Pair figures and picks against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import sampling, similarity


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pairs_against_all_pairs(spark, size):
    draw = np.random.default_rng(size)
    groups = {0: 90, 1: 1, 2: 2, None: 40}
    rows = [(g, 100 * k + i, (draw.standard_normal(5) * (1 + i % 3)).tolist()) for k, (g, n) in enumerate(groups.items()) for i in range(n)]
    rows += [(0, 9_000 + i, rows[0][2]) for i in range(20)] + [(2, 9_100, None)]
    df = spark.createDataFrame(rows, "label int, vec_id long, v array<double>").repartition(3)
    best = {r.label: r.best for r in similarity.best_dot(df, "label", "vec_id", "v", size).collect()}
    mean = {r.label: (r.pairs, r.mean_dot) for r in similarity.pair_figures(df, "label", "vec_id", "v").collect()}
    for g in groups:
        x = np.array([v for h, _, v in rows if h == g and v is not None])
        dots = (x @ x.T)[np.triu_indices(len(x), 1)]
        assert (g in best) == (g in mean) == (len(dots) > 0)
        if len(dots):
            assert best[g] == pytest.approx(dots.max()) and mean[g] == (len(dots), pytest.approx(dots.mean()))


def test_bounds_save_multiplications(spark):
    """Of well separated bundles of vectors, with a close pair in one, no two blocks are multiplied."""
    draw = np.random.default_rng(1)
    centres = np.eye(8)[:6] * 10
    rows = [(0, i, (centres[i % 6] + draw.standard_normal(8) * 0.01).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "label int, vec_id long, v array<double>")
    x = np.array([r[2] for r in rows])
    d = x @ x.T
    np.fill_diagonal(d, -np.inf)
    assert similarity.best_dot(df, "label", "vec_id", "v").first().best == pytest.approx(d.max())
    b = similarity.blocks(df, "label", "vec_id", "v", 1024).collect()
    bounds = [np.dot(p.centre, q.centre) + p.radius * np.linalg.norm(q.centre) + q.radius * np.linalg.norm(p.centre) + p.radius * q.radius for p in b for q in b if p.block < q.block]
    assert len(b) > 1 and sum(y > d.max() for y in bounds) < len(bounds)


@pytest.mark.parametrize("seed", range(3))
def test_picks_against_one_after_another(spark, seed):
    draw = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    rows = [(draw.choice([*names, "other"]), draw.randrange(14), k) for k in range(120)]
    expected, taken = [], set()
    for c in names:
        own = {}
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: -r[2]):
            own.setdefault(r[1], r)
        mine = [r for o, r in own.items() if o not in taken][:4]
        expected += mine
        taken |= {r[1] for r in mine}
    df = spark.createDataFrame(rows, "c string, w int, k int")
    assert [tuple(r) for r in sampling.unique_picks(df, "c", "w", [F.desc("k")], 4, names).collect()] == expected
    assert sampling.unique_picks(df.where("false"), "c", "w", [F.desc("k")], 4, names).count() == 0


def test_strata_that_are_short_or_absent(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "s string, k int")
    pick = lambda sizes: sorted((r.s, r.k) for r in sampling.fixed_per_stratum(df, F.col("s"), sizes, [F.desc("k")]).collect())
    assert pick({"a": 2, "b": 1}) == [("a", 3), ("a", 4), ("b", 9)]
    for sizes in ({"a": 2, "b": 2}, {"a": 1, "gone": 1}):
        with pytest.raises(Exception, match="too few rows in stratum"):
            pick(sizes)
