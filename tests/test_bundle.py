"""The bundle: a sound one passes, each mutation breaks its rule."""

import copy
import json

import pytest

from attestor.operators import bundle, derive, policy
from attestor.sources import schemas, synthetic

#: Two quays: a short teal boat west of a long rust one; three short boats, the middle one long, with an empty berth.
QUAYS = [
    synthetic.Scene("short", 2, (synthetic.Boat(0, "teal", 9), synthetic.Boat(1, "rust", 15))),
    synthetic.Scene("long", 4, (synthetic.Boat(0, "navy", 8), synthetic.Boat(2, "white", 18), synthetic.Boat(3, "ochre", 10)), "train"),
]


def ids(scene, kind, *names):
    return sorted(synthetic.opaque(kind, scene, n) for n in names)


@pytest.fixture(scope="module")
def sound(spark, tmp_path_factory):
    """Tables of a sound bundle as dicts, with the derived one, and its folder."""
    t = synthetic.bundle(QUAYS)
    root = synthetic.write(tmp_path_factory.mktemp("bundle"), t)
    tables, _ = bundle.read(spark, root)
    t["action_labels"] = [r.asDict() for r in derive.action_labels(tables).collect()]
    return t, synthetic.write(root, t)


def broken(spark, tmp_path, t, source=None):
    _, v = bundle.validate(spark, synthetic.write(tmp_path, t, source))
    return {(r.table, r.rule) for r in v.collect()}


def test_sound_bundle(spark, sound):
    t, root = sound
    tables, v = bundle.validate(spark, root)
    assert v.collect() == []
    assert bundle.counts(tables) == {n: len(t[n]) for n in schemas.SCHEMAS}
    # by hand: 2 + 2 + 1 (moored) + 1 (east) and 3 + 3 + 1 + 2 facts; 2 + 2 + 1 + 1 and 3 + 2 + 2 + 1 views; 4 captions each
    want = {"images": 2, "entities": 5, "facts": 6 + 9, "contexts": 8, "candidates": 6 + 8, "context_fact_labels": 4 * 6 + 4 * 9, "candidate_fact_labels": 6 * 6 + 8 * 9, "action_labels": 4 * 6 + 4 * 8}
    assert {n: len(t[n]) for n in want} == want
    assert all(schemas.columns(n) == [c for c in tables[n].columns if c != "_source_line"] for n in schemas.SCHEMAS)
    a = bundle.fingerprint(tables, ["facts"])
    assert a == bundle.fingerprint({"facts": tables["facts"].repartition(3)}, ["facts"])


def test_known_actions(sound):
    """By hand, from the layout of the quays."""
    of = {(r["context_id"], r["candidate_id"]): r for r in sound[0]["action_labels"]}

    def action(scene, context, view):
        return of[synthetic.opaque("ctx", scene, context), synthetic.opaque("cand", scene, view)]

    assert action("short", "first", "boat1")["new_supported_fact_ids"] == ids("short", "fact", "there1", "hull1", "moored1")
    assert action("short", "first", "pair1")["new_supported_fact_ids"] == ids("short", "fact", "there1", "hull1", "moored1", "east1")
    assert action("short", "first", "pair1")["repeated_fact_ids"] == ids("short", "fact", "there0", "hull0")
    assert action("short", "second", "pair1")["new_supported_fact_ids"] == []
    assert action("short", "first", "boat0")["eligible_missing_fact_ids"] == ids("short", "fact", "there1", "hull1", "moored1", "east1")
    # the east half of the long quay starts at pixel 32, where berth 2 does
    assert action("long", "second", "east")["new_supported_fact_ids"] == ids("long", "fact", "there2", "hull2", "east2")
    assert action("long", "second", "east")["repeated_fact_ids"] == ids("long", "fact", "there1", "hull1", "moored1")
    assert action("long", "first", "pair1")["pixel_cost"] == 11 * 8 + 11 * 18
    assert action("long", "whole", "stop")["eligible_missing_fact_ids"] == [] == action("long", "whole", "stop")["new_supported_fact_ids"]


def test_generator(spark, tmp_path):
    """Any seed makes a sound bundle, the same one each time, whose actions follow from the layout."""
    made = synthetic.scenes(5, 6)
    assert made == synthetic.scenes(5, 6) != synthetic.scenes(6, 6)
    t = synthetic.bundle(made)
    tables, form = bundle.read(spark, synthetic.write(tmp_path, t))
    t["action_labels"] = [r.asDict() for r in derive.action_labels(tables).collect()]
    of = {(r["context_id"], r["candidate_id"]): r for r in t["action_labels"]}
    for s in made:
        facts = synthetic.fact_rows(s)
        for c in synthetic.context_rows(s):
            for v in synthetic.view_rows(s):
                seen = {f["name"] for f in facts if synthetic.shows(s, v, f)}
                known = {f["name"] for f in facts if synthetic.knows(c, f)}
                r = of[synthetic.opaque("ctx", s.name, c["name"]), synthetic.opaque("cand", s.name, v["name"])]
                assert r["new_supported_fact_ids"] == ids(s.name, "fact", *(seen - known))
                assert r["repeated_fact_ids"] == ids(s.name, "fact", *(seen & known))
    assert form.count() == 0 and bundle.validate(spark, synthetic.write(tmp_path, t))[1].count() == 0


def change(table, row, **values):
    return lambda t: (row(t[table]) if callable(row) else t[table][row]).update(values)


def the(**wanted):
    """The first row with these values."""
    return lambda rows: next(r for r in rows if all(r[k] == v for k, v in wanted.items()))


MUTATIONS = {
    ("images", "leak:duplicate_group_id"): lambda t: t["images"][1].update(duplicate_group_id=t["images"][0]["duplicate_group_id"], split="test"),
    ("context_fact_labels", "cartesian"): lambda t: t["context_fact_labels"].pop(),
    ("context_fact_labels", "votes"): change("context_fact_labels", 0, annotator_votes=["entailed"]),
    ("context_fact_labels", "annotators"): change("context_fact_labels", 0, annotator_ids=["rater", "rater"]),
    ("context_fact_labels", "canonical"): change("context_fact_labels", 0, status="unknown"),
    ("contexts", "id"): change("contexts", 0, context_id="ctx_first"),
    ("contexts", "caption"): change("contexts", 0, initial_caption="\t "),
    ("observations", "unique"): lambda t: t["observations"].append(t["observations"][0]),
    ("observations", "exactly_once"): lambda t: t["observations"].pop(),
    ("observations", "cache_key"): change("observations", 0, prompt_hash="f" * 64),
    ("observations", "stop"): change("observations", the(status="stop"), observed_text="a gull"),
    ("candidates", "cost_is_area"): change("candidates", 0, pixel_cost=1),
    ("candidates", "boxes"): change("candidates", 0, boxes=[[2, 15, 13, 25]]),
    ("candidates", "stop_is_empty"): change("candidates", the(kind="stop"), boxes=[[1, 1, 2, 2]]),
    ("candidates", "revision"): change("candidates", 0, proposal_generator_revision="quay-views-2"),
    ("facts", "one_object"): lambda t: t["facts"][0]["object"].update(literal="x", entity_id=t["entities"][0]["entity_id"]),
    ("facts", "relation"): change("facts", the(fact_type="relation"), object={"literal": "pier"}),
    ("facts", "subject"): lambda t: t["facts"][0].update(subject_entity_id=t["entities"][-1]["entity_id"]),
    ("candidate_fact_labels", "invisible"): change("candidate_fact_labels", 0, visibility="none", visibility_adjudication="none", sufficient_to_verify="yes", adjudication="yes"),
    ("candidate_fact_labels", "cartesian"): lambda t: t["candidate_fact_labels"].pop(3),
    ("observation_claim_labels", "fact"): lambda t: t["observation_claim_labels"][0].update(mapped_fact_id=t["facts"][-1]["fact_id"]),
    ("context_metadata", "self_reference"): lambda t: t["context_metadata"][0].update(reference_context_id=t["context_metadata"][0]["context_id"]),
    ("context_metadata", "same_keys"): lambda t: t["context_metadata"].pop(),
    ("action_labels", "derived"): lambda t: t["action_labels"][0].update(pixel_cost=1),
    ("images", "form"): lambda t: t["images"][0].update(width=True),
    ("entities", "category"): change("entities", 0, category=""),
}


@pytest.mark.parametrize("part", range(3))
def test_mutations(spark, sound, tmp_path, part):
    """Several mutations at a time, as one broken rule stops no other."""
    t, wanted = copy.deepcopy(sound[0]), [k for i, k in enumerate(MUTATIONS) if i % 3 == part]
    for k in wanted:
        MUTATIONS[k](t)
    assert set(wanted) <= broken(spark, tmp_path, t)


def test_other_breakages(spark, sound, tmp_path):
    t = copy.deepcopy(sound[0])
    t["candidates"][0]["gold_target"] = "x"
    assert ("candidates", "form") in broken(spark, tmp_path / "a", t)
    from attestor.operators import rules

    d = spark.createDataFrame([(1, {"Answer": "x"})], "id int, m map<string,string>").withColumn("s", rules.F.struct(rules.F.lit(1).alias("target_id")))
    assert {r.key for r in rules.forbidden_keys(d, "t", schemas.FORBIDDEN_KEY_PARTS).collect()} == {"record.s.target_id", "record.m.Answer"}
    source = synthetic.provenance() | {"schema_version": "other", "unresolved_cross_split_near_duplicates": [1]}
    assert {("provenance", "schema_version"), ("provenance", "near_duplicates")} <= broken(spark, tmp_path / "b", copy.deepcopy(sound[0]), source)
    root = synthetic.write(tmp_path / "c", sound[0])
    with open(f"{root}/public/images.jsonl", "a") as f:
        f.write("\n[1, 2]\nnot json\n" + json.dumps([{"image_id": 1}]) + "\n")
    _, v = bundle.validate(spark, root)
    assert {(r.key, r.detail) for r in v.where("rule = 'form'").collect()} == {("4", "record must be an object"), ("5", "invalid JSON"), ("6", "record must be an object")}
    hashes = spark.createDataFrame([(sound[0]["images"][0]["image_path"], "0" * 64)], "image_path string, sha256 string")
    _, v = bundle.validate(spark, sound[1], hashes)
    assert {r.rule for r in v.collect()} == {"file", "file_hash"}


def test_selector_sees_no_gold(spark, sound):
    t, root = sound
    tables, _ = bundle.read(spark, root)
    (c,), (one,) = ids("short", "ctx", "first"), ids("short", "cand", "west")
    rows = bundle.selector_state(tables, c, (one,)).collect()
    assert [r.candidate_id for r in rows] == ids("short", "cand", "boat0", "boat1", "west", "east", "pair1", "stop")
    assert [r.candidate_id for r in rows if r.observed_text is not None] == [one]
    assert not any(p in name for r in rows for name in r.asDict() for p in ("fact", "gold", "label"))
    with pytest.raises(ValueError):
        bundle.selector_state(tables, c, (one, one))
    with pytest.raises(Exception, match="another image"):
        bundle.selector_state(tables, c, tuple(ids("long", "cand", "west"))).collect()


def test_evaluation(spark, sound):
    tables, _ = bundle.read(spark, sound[1])
    report = derive.evaluate(tables, samples=50)
    of = {(r.section, r.method): r for r in report.collect()}
    oracle, best = of["methods", "recognition_oracle"]["mean"], of["methods", "proposal_score"]["mean"]
    assert oracle >= max(r["mean"] for (s, _), r in of.items() if s == "methods") and oracle > best
    assert of["methods", "stop"]["mean"] == 0 and of["necessity", ""]["clusters"] == 2 and of["necessity", ""]["mean"] >= 0
    assert of["paraphrase", ""]["mean"] == 0
    first = derive.gates(report, bundle.eligible(tables)).first()
    assert not bundle.eligible(tables) and not first["first"] and not first["second"]
    shuffled = {n: d.repartition(3) for n, d in tables.items()}
    assert sorted(map(str, derive.evaluate(shuffled, samples=50).collect())) == sorted(map(str, report.collect()))
    with pytest.raises(ValueError):
        derive.evaluate(tables, baseline="recognition_oracle")
    rows = derive.context_rows(tables, derive.scored_actions(tables, derive.action_labels(tables)))
    assert rows.count() == 8 * (len(policy.POLICIES) + 1)
    assert derive.method_summary(rows).where("metric = 'delta_coverage'").count() == len(policy.POLICIES) + 1
    a = {(r.family, r.fact_type): r for r in bundle.agreement(tables).collect()}
    assert a[None, None].rows == 60 + 108 * 2 + len(sound[0]["observation_claim_labels"]) and a[None, None].raw_agreement == 1.0 and ("candidate_visibility", None) in a and (None, "relation") in a
