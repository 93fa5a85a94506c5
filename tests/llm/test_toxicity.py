"""Folding, places and scores against plain loops; learning on held-out labels."""

import math
import random
import zlib

import pytest

from attestor.llm import toxicity as t
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "text",
    ["You idiot.", "YOU IDIOT!", "іdіоt", "1d10t", "!d!ot", "|diot", "ｉｄｉｏｔ", "ïdïôt", "id​iot", "ídiot", "idio7", "idiot5", "idiots", "(idiot)", "idiot$$$ the", "***idiot"],
)
def test_disguises(text):
    assert [w for *_, w, _ in t.places(t.readings(text), t.automaton({t.term("idiot"): 1.0}, []))] == ["idiot"]


@pytest.mark.parametrize("text", ["", "idiotic", "videot", "10 1 0", "$$$ !!!", "i d i o t"])
def test_no_place(text):
    assert t.places(t.readings(text), t.automaton({"idiot": 1.0}, [])) == []


def test_exceptions_and_beginnings():
    machine = t.automaton({t.term("trash"): 2.0, "achi*": 1.0, "achixy": 3.0}, [t.term("trash can")])
    found = t.places(t.readings("Trash in the trash can, trash\ncan or tr4sh. Achixyz achixy"), machine)
    assert [(w, v) for *_, w, v in found] == [("trash", 2.0), ("trash", 2.0), ("achi*", 1.0), ("achixy", 3.0)]


def plain(texts, weights):
    """Places by trying every term at every place of every reading."""
    out = set()
    for text in texts:
        for a in range(len(text)):
            if a and text[a - 1].isalpha():
                continue
            for word in weights:
                stem = word.rstrip("*")
                rest = text[a + len(stem) :]
                if text.startswith(stem, a) and (word != stem or any(rest.startswith(x) and not rest[len(x) : len(x) + 1].isalpha() for x in ("", "s", "es"))):
                    out.add((a, a + len(stem), word, weights[word]))
    kept, reach = [], 0
    for x in sorted(out, key=lambda x: (x[0], -x[1])):
        if x[1] > reach:
            kept.append(x)
            reach = x[1]
    return kept


def test_places_against_plain_search():
    draw, weights = random.Random(3), {"aba": 1.0, "abab": 2.0, "ba": 3.0, "so*": 0.5, "soso": 4.0}
    machine = t.automaton(weights, [])
    for _ in range(400):
        folded = t.readings("".join(draw.choice("aabbos045$ .\n") for _ in range(draw.randrange(40))))
        assert t.places(folded, machine) == plain(folded, weights)


def model():
    return {"weights": {t.term(x): 2.0 for x in ("idiot", "loser")}, "exceptions": [], "power": 0.5, "intercept": -3.0, "slope": 4.0}


def test_scores_and_spans(spark):
    rows = [(1, "An 1d​iot and a loser."), (2, None), (3, ""), (4, "clean text"), (None, "idiot"), (5, "word " * 20_000 + "loser"), (1, "An 1d​iot and a loser."), (6, "w" * 30_000), (7, "\x00\x07 idiot")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, hits string, score double").repartition(3)
    found = sorted(t.scored(docs, model()).collect(), key=str)
    assert len(found) == len(rows)
    for r in found:
        text = next(x for k, x in rows if k == r.doc_id) or ""
        folded = t.readings(text)[0]
        x = math.log1p(2.0 * len(r.hits) / max(1.0, (folded.count(" ") + 1) / 100) ** 0.5)
        assert r.score == pytest.approx(1 / (1 + math.exp(3.0 - 4.0 * x))) and r.predicted == (r.score >= 0.3)
        assert [t.term(text[h.start : h.stop].replace("​", "")) for h in r.hits] == [h.term for h in r.hits]
    assert len(next(r for r in found if r.doc_id == 1).hits) == 2 and next(r for r in found if r.doc_id == 4).predicted == 0
    assert t.scored(docs.limit(0), model()).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "You stupid clown"), (2, "A fine day")], "doc_id long, text string")
    fitted = t.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.predicted for r in t.scored(docs, fitted).collect()} == {1: 1, 2: 0}


def test_learns_words_beginnings_and_exceptions(spark):
    draw, held = random.Random(9), lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    rows, labels = [], []
    for k in range(3_000):
        toxic = k % 5 == 0
        text = [f"w{draw.randrange(300)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(30)]
        if toxic:
            text.insert(draw.randrange(30), draw.choice(["grumbl", f"zorkel{chr(97 + k % 23)}{chr(97 + k % 19)}"]))
        elif k % 31 == 0:
            text.insert(draw.randrange(30), "grumbl pie")
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic != (held(k) and k % 2))))  # labels of held-out rows mislead
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fitted = t.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert t.term("grumbl pie") in fitted["exceptions"] and any(w.startswith("zor") and w.endswith("*") for w in fitted["weights"])
    right = [r.predicted == (r.doc_id % 5 == 0) for r in t.scored(docs, fitted).collect() if held(r.doc_id)]
    assert sum(right) / len(right) > 0.97


def test_held_out_labels(spark):
    """At sf0.01 three hundred labels suffice for the words that most toxic texts hold."""
    found = t.op11_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.held_out for r in found} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in held if r.toxic) >= 0.5 * sum(r.toxic for r in held)
