"""Data-parallel training against a loop over all rows; gradients against differences; maps against loops over masks."""

import numpy as np
import pyarrow as pa
import pytest

from attestor.operators import attribution, training

WIDTH = 4


def rows(n_images=30, seed=0):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n_images):
        for j in range(2 + i % 3):
            v = draw.standard_normal(WIDTH)
            t = [draw.standard_normal(WIDTH) for _ in range(3)]
            if j == 0:
                t[1] = v + 0.1 * t[1]
            out.append((f"im{i}", f"r{j}", j == 0, v.tolist(), *[x.tolist() for x in t]))
    return out


SCHEMA = "image string, region string, target boolean, v array<double>, omitting array<double>, complete array<double>, control array<double>"


def arrays(data):
    return np.array([r[3] for r in data]), [np.array([r[k] for r in data]) for k in (4, 5, 6)], np.array([r[2] for r in data])


@pytest.mark.parametrize("mode", list(training.MODES))
def test_gradients_against_differences(mode):
    v, captions, target = arrays(rows(8, 1))
    parts = training.Weights.start(WIDTH, 3, 6).parts
    n = int(target.sum()), int((~target).sum())
    _, g = training.loss_and_gradient(parts, v, captions, target, mode, *n)
    flat = np.concatenate([p.ravel() for p in parts])
    for k in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (training.loss_and_gradient(training.unflat(flat + s, parts), v, captions, target, mode, *n)[0] for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=2e-5)


@pytest.mark.parametrize("mode", ["rank_local_control", "supervised_omission"])
def test_training_equals_a_loop(spark, mode):
    data, back = rows(), rows(10, 5)
    fitted = training.fit(spark.createDataFrame(data, SCHEMA).repartition(3), spark.createDataFrame(back, SCHEMA), WIDTH, mode, seed=2, epochs=6, every=2, hidden=8)
    v, captions, target = arrays(data)
    parts = training.Weights.start(WIDTH, 2, 8).parts
    m, s = [0 * p for p in parts], [0 * p for p in parts]
    seen = {}
    for epoch in range(1, 7):
        loss, g = training.loss_and_gradient(parts, v, captions, target, mode, int(target.sum()), int((~target).sum()))
        for k, d in enumerate(training.unflat(g, parts)):
            m[k], s[k] = 0.9 * m[k] + 0.1 * d, 0.999 * s[k] + 0.001 * d * d
            parts[k] = parts[k] * (1 - 1e-5) - 1e-3 * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(s[k] / (1 - 0.999**epoch)) + 1e-8)
        if epoch % 2 == 0:
            bv, bc, _ = arrays(back)
            gains = []
            for image in dict.fromkeys(r[0] for r in back):
                at = [k for k, r in enumerate(back) if r[0] == image]
                first = []
                for c in bc[:2]:
                    q = training.scores(parts, bv[at], c[at], mode)[0]
                    first.append((q[0] == q.max()) / (q == q[0]).sum())
                gains.append(first[0] - first[1])
            seen[epoch] = (loss, float(np.mean(gains)), [p.copy() for p in parts])
    assert [(e, pytest.approx(x, abs=1e-9), pytest.approx(y, abs=1e-9)) for e, (x, y, _) in seen.items()] == fitted.history
    best = max(seen, key=lambda e: (seen[e][1], -e))
    assert fitted.best_epoch == best
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(fitted.parts, seen[best][2]))


def test_training_lowers_the_loss(spark):
    data = spark.createDataFrame(rows(40, 7), SCHEMA)
    h = training.fit(data, data, WIDTH, "rank", epochs=30, every=10, hidden=16).history
    assert h[-1][1] < h[0][1]


def test_masking_against_a_loop(spark):
    draw = np.random.default_rng(4)
    w = draw.standard_normal(3)
    items = [(f"i{k}", draw.standard_normal((5, 3)).tolist()) for k in range(6)]
    masks = [(k, draw.choice(5, size=1 + n, replace=False).tolist()) for k, _ in items for n in range(3)]
    masks += [(masks[0][0], masks[0][1][::-1] * 2), ("i0", [])]

    def scorer(batches):
        for b in batches:
            x = [np.array(p) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([float((p @ w).sum() ** 2) for p in x])], [b.schema.names[0], "mask", "score"])

    i, m = spark.createDataFrame(items, "id string, parts array<array<double>>"), spark.createDataFrame(masks, "id string, mask array<int>")
    for fill in (False, True):
        found = attribution.drops(i, m, "id", scorer, fill)
        expected = {}
        for key, parts in items:
            p = np.array(parts)
            for places in {tuple(sorted(set(x))) for k, x in masks if k == key and x}:
                q = p.copy()
                q[list(places)] = p.mean(0) if fill else 0
                expected[key, places] = (p @ w).sum() ** 2 - (q @ w).sum() ** 2
        assert {(r.id, tuple(r.mask)): r.drop for r in found.collect()} == pytest.approx(expected)
        values = {(r.id, r.place): r.importance for r in attribution.maps(found, "id").collect()}
        assert values == pytest.approx({(k, q): np.mean([d for (j, ps), d in expected.items() if j == k and q in ps]) for (k, ps) in expected for q in ps})
        regions = spark.createDataFrame([("i0", "a", [0, 1]), ("i0", "b", [9]), ("i1", "a", [])], "id string, region string, places array<int>")
        got = {(r.id, r.region): r.score for r in attribution.region_scores(attribution.maps(found, "id"), regions, "id", "region").collect()}
        known = [values[x] for x in (("i0", 0), ("i0", 1)) if x in values]
        assert got["i0", "b"] is None and got["i1", "a"] is None and got["i0", "a"] == (pytest.approx(-np.mean(known)) if known else None)
