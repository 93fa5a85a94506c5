"""What moves between tasks, and what reaches the driver, for queries that grew faster than their tables."""

import numpy as np
from pyspark.sql import functions as F

from attestor.functions import geometry as g
from attestor.operators import derive, joins, similarity
from attestor.plans import catalogue, evidence
from attestor.session import stored, table


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_contexts_and_candidates_are_not_shuffled(spark, sf):
    plan = optimized(derive.action_labels(evidence.evidence(lambda n: table(spark, sf, n))))
    top = plan[: plan.index("Join Inner, (image_id")]
    assert "Aggregate" not in top and "Join" not in top and "Window" not in top


def test_choices_and_means_read_actions_once(spark, sf):
    e = evidence.evidence(lambda n: table(spark, sf, n))
    scored = stored(derive.scored_actions(e, derive.action_labels(e)), "scored")
    assert optimized(derive.context_rows(e, scored)).count("Relation [") == 1


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hashes(spark):
    return spark.range(60).selectExpr("id", "xxhash64(id div 3) ^ shiftleft(1L, cast(id % 3 as int)) AS h")


def test_hashes_meet_without_broadcast(spark):
    d = hashes(spark)
    assert "Broadcast" not in physical(joins.hamming_pairs(d, d, "id", "h"))


def test_new_hashes_meet_old_ones_in_plain_expressions(spark):
    d = hashes(spark)
    found = joins.hamming_pairs(d.where("id % 2 = 0"), d.where("id % 2 = 1"), "id", "h", upper=False)
    assert "zip_with" not in physical(found) and "Broadcast" not in physical(found)
    rows = d.collect()
    want = sorted((a.id, b.id) for a in rows for b in rows if a.id % 2 == 0 and b.id % 2 == 1 and bin((a.h ^ b.h) % 2**64).count("1") <= 4)
    assert sorted((r.id_l, r.id_r) for r in found.collect()) == want


def test_best_cosine_multiplies_blocks(spark):
    x = np.random.default_rng(3).standard_normal((90, 5))
    x[4] = 0
    rows = [(i, i % 3 if i < 88 else i, None if i == 7 else x[i].tolist()) for i in range(90)]
    d = spark.createDataFrame(rows, "id long, g int, v array<double>")
    q = d.where("id % 4 = 0 OR id = 7 OR id = 89").withColumnRenamed("id", "q")
    got = {r.q: r.best for r in similarity.best_cosine(q, d, "g", "q", "id", "v", size=8).collect()}
    assert set(got) == {i for i in range(88) if i % 4 == 0} | {7}
    assert got[4] is None and got[7] is None
    for k in set(got) - {4, 7}:
        others = [i for i in range(88) if i % 3 == k % 3 and i not in (k, 4, 7)]
        assert abs(got[k] - max(x[k] @ x[i] / np.linalg.norm(x[k]) / np.linalg.norm(x[i]) for i in others)) < 1e-12


def test_captions_are_parsed_once_and_merged(spark, sf):
    plan = physical(catalogue.QUERIES["intervention_pairs"](spark, sf))
    assert "Broadcast" not in plan and plan.count("regexp_extract_all") == 1


def test_closest_pairs_need_no_window(spark, sf):
    plan = physical(catalogue.QUERIES["closest_unions"](spark, sf))
    assert "Window" not in plan


def test_patches_work_out_their_box_once(spark):
    d = spark.createDataFrame([(0.0, 0.0, 32.0, 16.0), (-9.0, -9.0, -5.0, -5.0), (23.0, 1.0, 24.0, 2.0), (100.0, 30.0, 190.5, 260.0)], "a double, b double, c double, d double")
    p = d.select("a", g.patches(F.array("a", "b", "c", "d")).alias("p"))
    assert physical(p).count("array(a#") == 1
    side = [(k + 0.5) * 16 for k in range(14)]
    want = [y * 14 + x for y in range(14) for x in range(14) if 100 <= side[x] < 190.5 and 30 <= side[y] < 260]
    assert {r.a: r.p for r in p.collect()} == {0.0: [0, 1], -9.0: [0], 23.0: [1], 100.0: want}
