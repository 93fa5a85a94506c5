"""Views, interventions and review packets."""

import math

from pyspark.sql import functions as F

from attestor.operators import views


def test_suppression(spark):
    rows = [("a", 0, [0, 0, 10, 10], 0.9), ("a", 1, [0, 0, 10, 9], 0.8), ("a", 2, [20, 20, 30, 30], 0.7), ("a", 3, [0, 0, 10, 10], 0.9), ("b", 0, [0, 0, 5, 5], 0.1)]
    d = spark.createDataFrame(rows, "image_id string, ord int, box array<int>, score double")
    assert sorted((r.image_id, r.ord) for r in views.suppress(d, "image_id").collect()) == [("a", 0), ("a", 2), ("b", 0)]
    assert sorted((r.image_id, r.ord) for r in views.suppress(d, "image_id", most=1).collect()) == [("a", 0), ("b", 0)]


def test_evidence_views(spark):
    images = spark.createDataFrame([("a", 100, 100), ("b", 10, 10)], "image_id string, width int, height int")
    boxes = [[0, 0, 10, 10], [12, 0, 22, 10], [80, 80, 90, 90], [0, 0, 100, 100]]
    d = spark.createDataFrame([("a", k, b, 0.9 - k / 10) for k, b in enumerate(boxes)], "image_id string, ord int, box array<int>, score double")
    v = views.evidence_views(images, d)
    n = {(r.image_id, r.view_family): r.n for r in v.groupBy("image_id", "view_family").agg(F.count("*").alias("n")).collect()}
    assert n == {("a", "grounded_entity"): 4, ("a", "grounded_entity_padded"): 4, ("a", "relation_union"): 2, ("a", "full_image"): 1, ("a", "stop"): 1, ("b", "full_image"): 1, ("b", "stop"): 1}
    unions = {tuple(r.grounding_indices): (r.boxes, r.proposal_score) for r in v.where("view_family = 'relation_union'").collect()}
    assert unions[0, 1] == ([[0, 0, 22, 10]], 0.8) and (1, 2) in unions
    assert v.select("candidate_id").distinct().count() == v.count()
    assert {r.pixel_cost for r in v.where("view_family = 'stop'").collect()} == {0}


def test_grid_and_contexts(spark):
    d = views.grid_candidates(spark.createDataFrame([("i", 10, 7)], "image_id string, width int, height int"))
    assert d.count() == 15 and d.where("kind = 'stop'").first().pixel_cost == 0
    assert d.select("candidate_id").distinct().count() == 15
    c = views.constructed_contexts(spark.createDataFrame([("i", "a", "b", "c", "d")], "image_id string, s string, e string, p string, w string"), "image_id", "s", "e", "p", "w")
    of = {r.context_kind: r for r in c.collect()}
    assert of["paraphrase"].reference_context_id == of["enriched"].context_id and of["sparse"].reference_context_id is None


def test_interventions(spark):
    lines = ["A [/EN#1/people young man] holds [/EN#2/other a red ball] near [/EN#3/scene the wall] .", "[/EN#2/other The red ball] is on the grass .", "Someone plays outside ."]
    captions = spark.createDataFrame([("i", k, x) for k, x in enumerate(lines)], "image_id string, caption_index int, line string")
    boxes = spark.createDataFrame([("i", "1", [[0, 0, 20, 20]]), ("i", "2", [[30, 30, 60, 60]]), ("i", "3", [[0, 0, 9, 9], [1, 1, 5, 5]])], "image_id string, name string, boxes array<array<int>>")
    got = {r.target_phrase: r for r in views.interventions(captions, boxes).collect()}
    assert set(got) == {"young man", "a red ball"}
    r = got["young man"]
    assert r.tminus == "A holds a red ball near the wall ." and r.tcontrol == "A young man holds near the wall ." and r.tplus == "A young man holds a red ball near the wall ."
    assert r.tmatched == "A unspecified person holds a red ball near the wall ." and r.tnatural == "The red ball is on the grass ."
    assert [x.id for x in r.regions] == ["1", "2"] and got["a red ball"].tnatural == "Someone plays outside ."


def test_review_packet(spark):
    d = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "k int, claim string")
    p = views.review_packet(d, 7, ["k"], ["vote_a", "vote_b"], ["claim"])
    rows = p.collect()
    assert p.columns == ["item_id", "claim", "vote_a", "vote_b", "notes"] and {r.vote_a for r in rows} == {""}
    assert [r.item_id for r in rows] == [r.item_id for r in views.review_packet(d.repartition(3), 7, ["k"], ["vote_a", "vote_b"], ["claim"]).collect()]
    assert rows != sorted(rows, key=lambda r: r.claim) and math.isclose(len({r.item_id for r in rows}), 6)
