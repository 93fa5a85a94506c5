"""Policies, metrics, resampling, sampling and joins on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import joins, metrics, models, policy, resample, rules, sampling


def test_necessity_and_switch(spark):
    a, b = {"x": 0.4, "y": 0.2, "stop": 0.0}, {"x": 0.0, "y": 0.2, "stop": 0.0}
    rows = [("im", c, k, v) for c, s in (("a", a), ("b", b)) for k, v in s.items()]
    d = spark.createDataFrame(rows, "image string, context string, id string, score double")
    r = metrics.necessity(d, "image", "context", "id", "score").first()
    assert math.isclose(r.gap, 0.1) and r.complete
    p = joins.pairs_within(d, ["image", "id"], "context", ["score"])
    assert metrics.switches(p, "id", "score_l", "score_r", ["image"]).first().material
    short = d.where("NOT (context = 'b' AND id = 'y')")
    assert not metrics.necessity(short, "image", "context", "id", "score").first().complete
    tied = spark.createDataFrame([("x", 0.2, 0.3), ("y", 0.2, 0.3)], "id string, l double, r double").withColumn("k", F.lit(1))
    r = metrics.switches(tied, "id", "l", "r", ["k"]).first()
    assert r.pair_regret == 0 and not r.material and not r.apart


def test_cluster_bootstrap(spark):
    d = spark.createDataFrame([("one", 0.0)] * 20 + [("two", 1.0)], "c string, v double")
    r = resample.ci(d, "c", "v", samples=100).first()
    assert (r["mean"], r.clusters) == (0.5, 2) and 0 <= r.lo <= 0.5 <= r.hi <= 1
    again = resample.ci(d.repartition(3), "c", "v", samples=100).first()
    assert tuple(r) == tuple(again)
    x = resample.numpy_ci(d, "c", "v", samples=1000)
    draws = np.random.default_rng(2271).integers(0, 2, size=(1000, 2))
    assert x["lo"] == np.quantile(np.array([0.0, 1.0])[draws].mean(1), 0.025) and x["mean"] == 0.5
    none = resample.ci(d.where("false"), "c", "v", samples=10).first()
    assert (none["mean"], none.lo, none.hi, none.clusters) == (None, None, None, 0)
    assert resample.numpy_ci(d.where("false"), "c", "v")["clusters"] == 0
    with pytest.raises(ValueError):
        resample.numpy_ci(d, "c", "v", most=1)


def test_intervals_rest_on_all_draws(spark):
    """10,000 draws by default, against the same draws made here."""
    import hashlib
    import inspect

    from attestor.operators import derive

    v = [0.0, 1.0, 5.0, 20.0]
    d = spark.createDataFrame(list(enumerate(v)), "c int, v double")
    drawn = np.array([[int(hashlib.sha256(f"2271:{b}:{x}".encode()).hexdigest()[:8], 16) % 4 for x in range(4)] for b in range(10_000)])
    e = np.sort(np.array(v)[drawn].mean(1))
    r = resample.ci(d, "c", "v").first()
    assert math.isclose(r.lo, np.quantile(e, 0.025)) and math.isclose(r.hi, np.quantile(e, 0.975))
    r = resample.ci(d, "c", "v", interpolate=False).first()
    assert math.isclose(r.lo, e[250]) and math.isclose(r.hi, e[9750])
    assert resample.estimates(d, "c", ["v"]).count() == resample.weighted(d, "c").select("b").distinct().count() == 10_000
    r = resample.statistic_ci(d, "c", {"v": F.col("v")}, lambda k: k["v"] / 4).first()
    assert math.isclose(r.lo, e[250]) and math.isclose(r.hi, e[9750])
    assert inspect.signature(derive.evaluate).parameters["samples"].default == 10_000


def test_statistic_equals_pooled_rows(spark):
    r = random.Random(1)
    rows = [(f"g{r.randrange(6)}", r.random() < 0.5, r.random() < 0.5) for _ in range(80)]
    d = spark.createDataFrame(rows, "c string, y boolean, p boolean")
    y, p = F.col("y"), F.col("p")
    counts = {"tp": (y & p).cast("int"), "fp": (~y & p).cast("int"), "fn": (y & ~p).cast("int")}
    got = resample.statistic_ci(d, "c", counts, lambda k: metrics.f1_columns(k["tp"], k["fp"], k["fn"])["f1"], samples=40).first()
    names = sorted({c for c, _, _ in rows})
    import hashlib

    values = []
    for b in range(40):
        pooled = [x for s in range(len(names)) for x in rows if x[0] == names[int(hashlib.sha256(f"2271:{b}:{s}".encode()).hexdigest()[:8], 16) % len(names)]]
        tp, fp, fn = (sum(1 for _, u, w in pooled if (u, w) == k) for k in ((True, True), (False, True), (True, False)))
        values.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    values.sort()
    assert math.isclose(got.lo, values[1]) and math.isclose(got.hi, values[39])
    w = resample.weighted(d, "c", samples=40)
    assert w.groupBy("b").agg(F.sum("w").alias("n")).count() == 40


def test_random_rate_is_ratio_of_means(spark):
    rows = [("c", "a", 10, [], [], ["u"], [], ["1", "2"]), ("c", "b", 20, [], ["x"], [], [], [])]
    d = spark.createDataFrame(rows, "context_id string, candidate_id string, pixel_cost int, repeated_fact_ids array<string>, contradicted_claim_ids array<string>, unknown_claim_ids array<string>, eligible_missing_fact_ids array<string>, new_supported_fact_ids array<string>").withColumn("fact_count", F.lit(4))
    d = d.withColumns(policy.action_metrics())
    r = policy.expected_random(d, ["context_id"]).first()
    assert math.isclose(r.invalid_claim_rate, 1 / 3) and r.delta_coverage == 0.25 and r.repeat_rate == 0 and r.uncovered_fact_recall is None


def test_tie_breaks(spark):
    d = spark.createDataFrame([("g", "a", 1.0, 3), ("g", "b", 1.0, 1), ("g", "c", 0.5, 2)], "g string, id string, s double, o int")
    r = d.groupBy("g").agg(policy.largest_id_wins("id", "s").alias("x"), policy.smallest_id_wins("id", -F.col("s")).alias("y"), policy.first_wins("id", "s", "o").alias("z")).first()
    assert (r.x, r.y, r.z) == ("b", "a", "b")


def test_vote_rules(spark):
    cases = [("yes", "no", "uncertain", "uncertain"), ("yes", "no", "", None), (" Yes", "yes", None, "yes"), ("", "yes", "no", None)]
    d = spark.createDataFrame(cases, "a string, b string, c string, want string").withColumn("got", metrics.resolved_vote("a", "b", "c"))
    assert all(r.got == r.want for r in d.collect())
    cases = [(["yes"] * 3, "positive"), (["yes", "no", "uncertain"], "negative"), (["yes", "yes", "uncertain"], "unknown"), (["yes"], None), (["yes", "yes", None], None)]
    d = spark.createDataFrame(cases, "v array<string>, want string").withColumn("got", metrics.action_target("v"))
    assert all(r.got == r.want for r in d.collect())
    d = spark.createDataFrame([("Jo",), ("Codex",), ("AI review 2",), ("a non-human one",)], "n string").select(rules.is_human("n"))
    assert [r[0] for r in d.collect()] == [True, False, False, False]


def test_agreement_by_hand(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    r = metrics.agreement(d, "x", "y").first()
    assert r.raw_agreement == 0.75 and math.isclose(r.kappa, (0.75 - 0.5) / 0.5)
    assert metrics.agreement(d.where("x = 'a' AND y = 'a'"), "x", "y").first().kappa is None


def test_hamming_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))) for b in base for _ in range(6)]
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    d = spark.createDataFrame(list(enumerate(signed)), "id int, h long")
    got = {(x.id_l, x.id_r, x.distance) for x in joins.hamming_pairs(d, d, "id", "h").collect()}
    n = joins.hamming_pairs(d, d, "id", "h").count()
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 4}
    assert got == want and n == len(want)


def test_joins(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 5)], "k int, y int")
    assert [tuple(r) for r in joins.with_default(left, right, ["k"], y=0).orderBy("k").collect()] == [(1, "a", 5), (2, "b", 0)]
    with pytest.raises(Exception, match="no match for 2"):
        joins.asserted(left, right, ["k"], "right").collect()
    assert joins.asserted(left.where("k = 1"), right, ["k"], "right").count() == 1
    assert [r.k for r in joins.pending(left, right, ["k"]).collect()] == [2]
    hits = joins.phrase_hits(spark.createDataFrame([(1, "A red ball, here"), (2, "red balloon")], "d int, t string"), "d", "t", spark.createDataFrame([(7, "red ball"), (8, "ball here"), (9, "!"), (10, "a red ball here and there")], "i int, p string"), "i", "p")
    assert sorted(map(tuple, hits.collect())) == [(1, 7), (1, 8)]


def test_sampling(spark):
    d = spark.createDataFrame([(b, k) for b, n in (("x", 5), ("y", 1), ("z", 3)) for k in range(n)], "b string, k int")
    got = [(r.b, r.k) for r in sampling.round_robin(d, "b", [F.col("k")], 7).collect()]
    assert got == [("x", 0), ("y", 0), ("z", 0), ("x", 1), ("z", 1), ("x", 2), ("z", 2)]
    with pytest.raises(Exception, match="too few rows in y"):
        sampling.first_n(d, "b", ["k"], 2).collect()
    with pytest.raises(Exception, match="too few rows in stratum y"):
        sampling.fixed_per_stratum(d, F.col("b"), {"y": 2}, [F.col("k")]).collect()
    assert sampling.one_per_group(d, "b", ["b", "k"], 1).count() == 3
    o = sampling.offsets(d, "b", ["k"], "k")
    assert sampling.broken_offsets(o, "b", ["k"], "start", "stop").count() == 0
    assert sampling.broken_offsets(o.withColumn("start", F.col("start") + 1), "b", ["k"], "start", "stop").count() > 0
    up = sampling.overriding(d, d.where("k = 0").withColumn("k", F.lit(9)), ["b"])
    assert {r.k for r in up.collect()} == {9}
    picks = sampling.unique_picks(spark.createDataFrame([("p", 1, 5), ("q", 1, 9), ("q", 2, 7), ("q", 3, 1)], "cat string, im int, s int"), "cat", "im", [F.desc("s")], 2, ["p", "q"])
    assert [(r.cat, r.im) for r in picks.collect()] == [("p", 1), ("q", 2), ("q", 3)]
    c = sampling.by_custom_order(d.select("b").distinct(), "b", ["z", "x"], "b")
    assert [r.b for r in c.collect()] == ["z", "x", "y"]


def test_unique_match(spark):
    d = spark.createDataFrame([("ENTAILMENT",), ("neutral",), ("neutral",)], "l string")
    assert metrics.unique_match(d, "l", "neutral").first()[0] == "neutral"
    with pytest.raises(Exception, match="not exactly one"):
        metrics.unique_match(d, "l", "e").collect()


def test_ridge_equals_numpy(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 5)), r.normal(size=60)
    d = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    mean, scale, w = models.ridge(d, "x", "y", 5, 3.0)
    z = np.column_stack(((x - x.mean(0)) / x.std(0, ddof=1), np.ones(60)))
    want = np.linalg.solve(z.T @ z + 3 * np.eye(6), z.T @ y)
    assert np.allclose(w, want)
    got = [q[0] for q in d.select(models.ridge_score("x", (mean, scale, w))).collect()]
    assert np.allclose(got, z @ want)


def test_kmeans_and_losses(spark):
    x = np.array([[2, 0], [1.9, 0.3], [0, 5], [0.2, 3], [-4, 0]], float)
    assert models.directions(x[:0], 3).tolist() == [] and models.directions(x[:2], 3).tolist() == [0, 1]
    assert models.directions(np.zeros((3, 2)), 2).tolist() == [0, 0, 0]
    assert models.directions(x, 3).tolist() == [0, 0, 2, 2, 1]
    d = spark.createDataFrame([("a", k, list(map(float, p))) for k, p in enumerate(x)], "g string, k int, v array<double>")
    assert {r.k: r.cluster for r in models.direction_clusters(d, "g", "k", "v", 3).collect()} == dict(enumerate([0, 0, 2, 2, 1]))
    row = spark.createDataFrame([([2.0, 1.0, 5.0], [1.0, 2.0, 0.0], [True, False, False], [True, True, False])], "a array<double>, b array<double>, y array<boolean>, m array<boolean>")
    r = row.select(models.listwise_loss("a", "y", "m").alias("l"), models.symmetric_kl("a", "b", "m").alias("k"), models.symmetric_kl("a", "a", "m").alias("z")).first()
    p = math.e / (1 + math.e)
    assert math.isclose(r.l, -math.log(p)) and math.isclose(r.k, (p - (1 - p)) * 1.0) and r.z == 0
    several = spark.createDataFrame([([2.0, 1.0, 0.5], [True, False, True], [True, True, True]), ([1.0], [False], [True])], "a array<double>, y array<boolean>, m array<boolean>")
    found = [r.l for r in several.select(models.listwise_loss("a", "y", "m").alias("l")).collect()]
    total = math.log(sum(math.exp(x) for x in (2.0, 1.0, 0.5)))
    assert math.isclose(found[0], total - (2.0 + 0.5) / 2) and found[1] is None  # each positive counts, not their mass together
    shuffled = models.shuffled_features(d.withColumn("owner", F.col("k") % 3), "k", "owner", "v", bucket_rows=1_000)
    assert shuffled.count() == 5


def test_shuffled_features_are_of_other_owners(spark):
    """Every owner gets the vector of another one, each once, though most are alone in their bucket."""
    for n in (2, 30):
        d = spark.createDataFrame([(k, k % n, [float(k % n)]) for k in range(2 * n)], "k int, owner int, v array<double>")
        for rows in (1, 8, 1_000):
            got = models.shuffled_features(d, "k", "owner", "v", bucket_rows=rows).collect()
            assert len(got) == 2 * n and all(r.shuffled != r.v for r in got)
            assert sorted({(r.owner, r.shuffled[0]) for r in got})[n - 1][0] == n - 1 and len({r.shuffled[0] for r in got}) == n


def test_completion_and_stacking(spark):
    from attestor.operators import joins, sampling

    sheet = spark.createDataFrame([("a", "x", None, True), ("a", " ", "y", False), ("b", "", None, False)], "g string, p string, q string, need boolean")
    got = {r.g: (r.rows, r.filled, r.required, r.rate) for r in metrics.completion(sheet, {"p": F.lit(True), "q": F.col("need")}, ["g"]).collect()}
    assert got == {"a": (2, 1, 3, 1 / 3), "b": (1, 0, 1, 0.0)}
    assert metrics.completion(sheet, {"q": F.lit(False)}).first().rate is None
    d = spark.range(1000).repartition(7).withColumn("s", F.col("id") % 3)
    rows, ranges = joins.stacked({"one": d.where("s = 1"), "none": d.where("false"), "two": d.where("s = 2")}, ["id"])
    assert {r.part: (r.start, r.stop) for r in ranges.collect()} == {"one": (0, 333), "two": (333, 666)}
    assert [r.id for r in rows.orderBy("row").collect()] == [k for k in range(1000) if k % 3 == 1] + [k for k in range(1000) if k % 3 == 2]
    assert [r.row for r in rows.orderBy("row").collect()] == list(range(666))
    assert joins.gathered(d, "id", spark.createDataFrame([(7, 5), (8, 5)], "item int, at long"), "at").count() == 2
    assert sampling.early_exit(d, F.col("s") == 2, 4).count() == 4


def test_hashes_meet_once(spark):
    """Many rows of one hash are compared as one hash; pairs equal those of all comparisons."""
    from attestor.operators import joins

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40)
    h = [int(base[k % 40] ^ (1 << int(rng.integers(60))) ^ (1 << int(rng.integers(60)))) if k % 3 else int(base[k % 40]) for k in range(240)]
    d = spark.createDataFrame(list(enumerate(h)), "id long, h long")
    want = {(i, j, (h[i] ^ h[j]).bit_count()) for i in range(240) for j in range(i + 1, 240) if (h[i] ^ h[j]).bit_count() <= 4}
    got = joins.hamming_pairs(d, d, "id", "h").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
