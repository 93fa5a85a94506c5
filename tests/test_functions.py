"""Functions on hand-computed values."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from attestor.functions import geometry as g
from attestor.functions import hashing as h
from attestor.functions import numeric as n
from attestor.functions import strings as s
from attestor.functions import vectors as v


@pytest.fixture(scope="module")
def one(spark):
    def run(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())

    return run


L = F.lit


def test_numbers(spark, one):
    d = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (3.0,)], "x double")
    assert d.agg(n.finite_mean("x")).first()[0] == 2.0
    assert d.where("x is null").agg(n.finite_mean("x")).first()[0] is None
    assert one(n.ratio(L(1), L(0)), n.ratio_or_zero(L(1), L(0)), n.kappa(L(1.0), L(1.0))) == (None, 0.0, None)
    acc, mrr = one(n.expected_top1(L(0), L(3)), n.expected_reciprocal_rank(L(0), L(3)))
    assert math.isclose(acc, 1 / 3) and math.isclose(mrr, (1 + 1 / 2 + 1 / 3) / 3)
    assert one(n.scaled(L(2.0), L(1e-9)), n.scaled(L(2.0), L(4.0))) == (0.0, 0.5)
    empty = F.array().cast("array<string>")
    assert one(n.jaccard(empty, empty), n.jaccard(L(["a"]), L(["a", "b"]))) == (1.0, 0.5)
    assert one(n.index_quantile(L(list(range(200))), 0.025), n.index_quantile(L(list(range(200))), 0.975)) == (5, 195)


def test_words(one):
    assert one(s.norm_words(L("The Red-ball, ok!")), s.norm_words(L(""))) == (["the", "red", "ball", "ok"], [])
    assert one(s.contains_phrase(L("A red ball."), L("RED ball")), s.contains_phrase(L("a redball"), L("red")), s.contains_phrase(L("x"), L(""))) == (True, False, True)
    assert one(s.ngrams(L(["the", "red", "ball"]), 2, ("the",)))[0] == ["ball", "red", "red ball", "the red"]
    assert one(s.ngrams(F.array().cast("array<string>"), 2))[0] == []
    assert one(s.delete_words(L(["a", "b", "c", "d"]), L(1), L(3)))[0] == "a d"
    assert one(s.word_count(L(" a  b\n")), s.word_count(L(" ")), s.same_text(L(" A  b"), L("a B\t"))) == (2, 0, True)
    assert one(s.joined_query(L(["b..", "a. "])), s.stem(L("/x/y.tar.gz")), s.stem(L("name"))) == ("a . b .", "y.tar", "name")
    assert one(s.span_valid(L(0), L(3), L("abc")), s.span_valid(L(2), L(2), L("abc")), s.span_valid(L(0), L(4), L("abc"))) == (True, False, False)
    assert one(s.with_prior(L("p"), L(None).cast("string"), " q: "), s.with_prior(L("p"), L("x"), " q: ")) == ("p", "p q: x")


def test_generalise(one):
    cases = [("young man", ["people"], "unspecified person"), ("man", ["people"], "person"), ("person", ["people"], "entity"), ("a big red dog", ["animals"], "a unspecified unspecified animal"), ("a thing", ["other"], "a entity"), ("an arm", ["bodyparts"], "an body"), ("two cars", [], "two thing")]
    for phrase, types, want in cases:
        assert one(s.generalise(L(phrase), L(types) if types else F.array().cast("array<string>")))[0] == want, phrase


def test_labels(one):
    entail, support = ["ENTAILED", "NOT_ENTAILED", "CONTRADICTED"], ["SUPPORTED", "PARTIAL", "INVALID", "UNINFORMATIVE"]
    assert one(s.label(L("NOT ENTAILED."), entail), s.label(L("SUPPORTIVE"), support, {"SUPPORTIVE": "SUPPORTED"}), s.label(L("maybe"), entail)) == ("NOT_ENTAILED", "SUPPORTED", None)
    assert one(s.recovered_label(L("Answer: INVALID."), support), s.recovered_label(L("SUPPORTED or INVALID"), support)) == ("INVALID", None)
    assert one(s.coded_label(L(" b) yes"), {"A": "x", "B": "y"}), s.coded_label(L("q"), {"A": "x"})) == ("y", None)
    got = one(*[s.choice(L(x), L(5), L(4)) for x in ("CHOICE=3", "choice = 4 ", "I pick 2", "STOP", "9", "none", "")])
    assert got == (3, 4, 2, 4, -1, -1, -1)
    two = ["ambiguous", "unambiguous"]
    assert one(*[s.binary_label(L(x), two, {"a": "ambiguous"}) for x in (" A.", "*unambiguous*", "it is ambiguous", "ambiguous or unambiguous")]) == ("ambiguous", "unambiguous", "ambiguous", None)
    words = ["NO_NEW_FACT"]
    assert one(s.is_sentinel(L(" no_new_fact\n"), words), s.is_sentinel(L(" no_new_fact"), words, exact=True), s.is_sentinel(L("NO_NEW_FACT"), words, exact=True)) == (True, False, True)


def test_json_and_inline(one):
    keys = ["a", "b", "c"]
    good = '```json\n{"a": "x", "b": "y", "c": "z"}\n```'
    assert one(s.fenced_json(L(good), keys))[0] == {"a": "x", "b": "y", "c": "z"}
    assert one(*[s.fenced_json(L(x), keys) for x in ('{"a": "x", "b": "y"}', '{"a": "x", "b": " ", "c": "z"}', "no", '{"a":"x","b":"y","c":"z","d":"w"}')]) == (None,) * 4
    r = one(s.parse_inline(L("A [/EN#1/people young man] holds [/EN#2/other/x a red ball] .")))[0]
    assert r.text == "A young man holds a red ball ."
    assert [(p.id, p.types, p.phrase, p.start, p.stop) for p in r.phrases] == [("1", ["people"], "young man", 1, 3), ("2", ["other", "x"], "a red ball", 4, 7)]


def test_hashes(one):
    assert one(h.opaque("img", L("a"), L(7)))[0] == "img_" + hashlib.sha256(b"a\x1f7").hexdigest()[:16]
    assert one(h.opaque_json("c", L("a"), L("b")))[0] == "c_" + hashlib.sha256(b'["a","b"]').hexdigest()[:16]
    want = hashlib.sha256(json.dumps({"b": [1, 2], "a": None}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(h.cache_key(b=L([1, 2]), a=L(None).cast("string")))[0] == want
    for k in range(50):
        assert one(h.mod10(L(f"s:{k}")))[0] == int(hashlib.sha256(f"s:{k}".encode()).hexdigest(), 16) % 10
    a, b = "f0000000000000ff", "0000000000000001"
    assert one(h.hamming(h.hex64(L(a)), h.hex64(L(b))))[0] == bin(int(a, 16) ^ int(b, 16)).count("1")


def test_table_fingerprint(spark):
    d = spark.range(100).selectExpr("id", "id * 2 AS x")
    a = h.table_fingerprint(d).first()[0]
    assert a == h.table_fingerprint(d.repartition(7).select("x", "id")).first()[0]
    assert a != h.table_fingerprint(d.where("id > 0")).first()[0]
    assert h.run_fingerprint(a=1, b="x") == h.run_fingerprint(b="x", a=1)


def test_boxes(one):
    a, b, c = L([0, 0, 10, 10]), L([9, 9, 12, 12]), L([10, 0, 12, 2])
    assert one(g.overlaps(a, b), g.overlaps(a, c), g.area(b), g.union(a, b)) == (True, False, 9, [0, 0, 12, 12])
    assert one(g.valid(a, L(10), L(10)), g.valid(b, L(10), L(10)), g.valid(L([0, 0, 0, 5]), L(10), L(10)), g.valid(L([1, 2]), L(9), L(9))) == (True, False, False, False)
    assert one(g.padded(L([10, 10, 20, 20]), L(21), L(100)), g.from_one_based(L(1), L(1), L(12), L(5), L(10), L(10))) == ([8, 8, 21, 22], [0, 0, 10, 5])
    assert one(g.center_score(F.array().cast("array<array<int>>"), L(10), L(10)), g.center_score(F.array(a), L(10), L(10))) == (float("-inf"), 0.0)
    assert math.isclose(one(g.center_distance(a, c, L(10), L(10)))[0], math.hypot(0.6, 0.4))
    assert len(one(g.grid(L(10), L(7)))[0]) == 14
    assert one(g.grid(L(5), L(5)))[0][9:11] == [[0, 0, 2, 5], [2, 0, 5, 5]]  # half to even
    crop = one(g.center_crop(L([0, 0, 100, 50]), L(200), L(100)))[0]
    assert math.isclose(crop.visible, 0.5) and one(g.visibility_group(L(0.5)), g.visibility_group(L(0.0)), g.visibility_group(L(1.0))) == ("partial", "invisible", "full")
    assert one(g.patches(L([0.0, 0.0, 32.0, 16.0])), g.patches(L([-9.0, -9.0, -5.0, -5.0])), g.patches(L([23.0, 1.0, 24.0, 2.0]))) == ([0, 1], [0], [1])
    assert one(g.feature_vector(F.array(L([0, 0, 5, 10])), L(10), L(10)))[0] == [0.0, 0.0, 0.5, 1.0, 0.5, 0.5]
    assert one(g.one_hot(L("b"), ["a", "b"]))[0] == [0.0, 1.0]


def test_vectors(one):
    a, b = L([3.0, 4.0]), L([4.0, 3.0])
    assert one(v.dot(a, b), v.norm(a), v.cosine(a, b), v.cosine(a, L([0.0, 0.0]))) == (24.0, 5.0, 0.96, None)
    assert one(v.unit(a))[0] == [0.6, 0.8] and math.isclose(one(v.inverse_cosine(a, b))[0], 0.02)
    m = F.create_map(L("x"), L(0.4), L("a"), L(0.4), L("z"), L(0.2))
    assert one(v.top_label(m), v.symmetric_margin(L(1.0), L(-3.0))) == ("a", 2.0)
    got = one(v.log_softmax(L([1.0, 2.0, 9.0]), L([True, True, False])))[0]
    assert math.isclose(sum(math.exp(x) for x in got[:2]), 1) and got[2] is None
