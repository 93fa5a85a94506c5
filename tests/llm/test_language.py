import math
import zlib

import numpy as np
import pyarrow as pa

from attestor.llm import language
from tests.llm.util import frame, odd_rows, save


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = language.op5_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == truth[r.doc_id].lang for r in held]
    assert np.mean(right) > 0.97, np.mean(right)
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05
    assert all(0 <= r.score <= 1 for r in rows)


def test_penalties_select(spark):
    """Penalties are chosen on held-back rows: they leave most columns without a weight, and cost no accuracy."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        y = int(rng.integers(2))
        at = np.unique(np.concatenate((rng.choice(2000, 20, replace=False), [2000 + y, 2002])))
        rows.append((np.append(at, 3000), np.append(np.full(len(at), 1 / len(at)), 1.0), y))
    train, back = rows[:320], rows[320:]
    w, logits = language.chosen(train, back, np.array([y for *_, y in back]), 2, 3000)
    assert (logits.argmax(1) == [y for *_, y in back]).mean() == 1
    weak = language.ftrl(train, 2, 3000, *language.PENALTIES[-1])
    assert (w != 0).sum() < 0.5 * (weak != 0).sum() and np.abs(w[2000:2002]).min() > 0 and (weak[:2000] != 0).mean() > 0.9


def test_labels_of_held_out_rows_are_not_seen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    F = language.F
    other = docs.withColumn("lang", F.when(language.is_held_out(), "xx").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(other)
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_odd_rows(spark, tmp_path):
    got = {r.doc_id: r for r in language.op5_language_id(spark, save(spark, tmp_path)).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    assert got[7].lang_pred == "en"
    assert language.op5_language_id(spark, save(spark, tmp_path, [], "none")).count() == 0
    unlabelled = [(1, "some words", *[None] * 8)]
    assert language.op5_language_id(spark, save(spark, tmp_path, unlabelled, "u")).first().lang_pred == "und"


def test_sums_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=(len(language.ORDERS) * language.DIMS, 2)).astype(np.float32), np.array([0.1, -0.2])
    rows = [r for r in odd_rows() if r[0] is not None and r[1]]
    got = {r.doc_id: r.score for r in language.predict(frame(spark, rows), (["a", "b"], weights, bias)).collect()}
    for r in rows:
        _, sizes, n_letters, hashed = language.columns(pa.array([r[1]]))
        x = bias + sum(weights[h].astype(float).sum(0) / max(1, sizes[0] - n + 1) for n, h in zip(language.ORDERS, hashed))
        want = language.softmax(x).max() if n_letters[0] else 0
        assert abs(got[r[0]] - want) < 1e-6


def test_ftrl_against_a_plain_loop():
    """Follow-the-regularised-leader, one coordinate at a time, from the closed form of its minimum."""
    draw = np.random.default_rng(3)
    rows = []
    for k in range(40):
        at = np.append(np.sort(draw.choice(12, size=4, replace=False)), 12)
        rows.append((at, np.append(draw.random(4), 1.0), k % 3))
    for l1, l2 in language.PENALTIES:
        w = {}
        z, n = {}, {}
        for _ in range(language.EPOCHS):
            for at, value, y in rows:
                for i in at.tolist():
                    for c in range(3):
                        zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
                        # argmin of z w + |w| l1 + w^2 ((beta + sqrt n) / alpha + l2) / 2
                        w[i, c] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((language.BETA + math.sqrt(ni)) / language.ALPHA + l2)
                s = [sum(v * w[i, c] for i, v in zip(at.tolist(), value.tolist())) for c in range(3)]
                e = [math.exp(x - max(s)) for x in s]
                for i, v in zip(at.tolist(), value.tolist()):
                    for c in range(3):
                        g = v * (e[c] / sum(e) - (c == y))
                        ni = n.get((i, c), 0.0)
                        z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / language.ALPHA * w[i, c]
                        n[i, c] = ni + g * g
        found = language.ftrl(rows, 3, 12, l1, l2)
        assert all(math.isclose(found[i, c], x, abs_tol=1e-9) for (i, c), x in w.items())


def test_temperature_is_the_likeliest_of_its_grid():
    draw = np.random.default_rng(4)
    logits = draw.standard_normal((200, 3)) * 5
    y = (logits + draw.gumbel(size=(200, 3)) * 3).argmax(1)  # a temperature of about 3

    def loss(t):
        return -sum(math.log(math.exp(r[k] / t) / sum(math.exp(v / t) for v in r) + 1e-12) for r, k in zip(logits.tolist(), y.tolist()))
    t = language.temperature(logits, y)
    assert 2 < t < 4.5 and loss(t) <= min(loss(t * f) for f in (0.8, 0.95, 1.05, 1.25)) + 1e-9
