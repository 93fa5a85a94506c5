"""The set-valued selector: order, masks, gradients against differences, and training against one task."""

import numpy as np
import pytest

from attestor.operators import selector


def lists(n=6, seed=1):
    draw, out = np.random.default_rng(seed), []
    for k in range(n):
        size = 2 + k % 4
        valid = np.array([True] * size + [False] * (k % 2))
        positive = np.zeros(len(valid), bool)
        positive[: 1 + k % 2] = True
        out.append((draw.standard_normal((len(valid), 3)), draw.standard_normal(2), positive, valid, draw.standard_normal(2) if k % 3 == 0 else None))
    return out


def weights(seed=0):
    w = selector.start(3, 2, hidden=8, layers=2, seed=seed)
    draw = np.random.default_rng(seed + 1)
    return {k: v + 0.1 * draw.standard_normal(v.shape) for k, v in w.items()}


def test_scores_move_with_candidates():
    w = weights()
    for c, x, _, valid, _ in lists():
        s, _ = selector.Pass(w, 2, {}).logits(c, x, valid)
        order = np.random.default_rng(2).permutation(len(c))
        moved, _ = selector.Pass(w, 2, {}).logits(c[order], x, valid[order])
        assert np.allclose(moved[valid[order]], s[order][valid[order]])
        other = c.copy()
        other[~valid] += 100  # what is not valid is not seen
        assert np.allclose(selector.Pass(w, 2, {}).logits(other, x, valid)[0][valid], s[valid]) and np.isneginf(s[~valid]).all()


def test_gradients_against_differences():
    w, data = weights(), lists()
    _, g = selector.list_gradient(w, 2, data, 6, 2)
    for name in w:
        flat = w[name].reshape(-1)
        for k in {0, flat.size // 2, flat.size - 1}:
            values = []
            for step in (1e-6, -1e-6):
                changed = {n: v.copy() for n, v in w.items()}
                changed[name].reshape(-1)[k] += step
                values.append(selector.list_gradient(changed, 2, data, 6, 2)[0])
            assert g[name].reshape(-1)[k] == pytest.approx((values[0] - values[1]) / 2e-6, abs=3e-6), name


def test_losses():
    valid = np.array([True, True, True, False])
    x = np.array([2.0, 1.0, 0.5, -np.inf])
    total = np.log(np.exp([2.0, 1.0, 0.5]).sum())
    assert selector.list_loss(x, np.array([True, False, True, True]), valid)[0] == pytest.approx(total - 1.25)
    assert selector.divergence(x, x, valid)[0] == 0
    with pytest.raises(ValueError):
        selector.list_loss(x, np.array([False, False, False, True]), valid)


def test_training_equals_one_task(spark):
    data, w = lists(9, 4), weights(3)
    rows = [(k, c.tolist(), x.tolist(), y.tolist(), m.tolist(), None if t is None else t.tolist()) for k, (c, x, y, m, t) in enumerate(data)]
    df = spark.createDataFrame(rows, "k int, candidates array<array<double>>, context array<double>, positive array<boolean>, valid array<boolean>, twin_context array<double>")
    fitted, history = selector.fit(df.repartition(4), w, heads=2, epochs=3)
    at, optimiser, losses = dict(w), selector.AdamW(list(w.values())), []
    for _ in range(3):
        loss, g = selector.list_gradient(at, 2, data, 9, 3)
        losses.append(loss)
        at = dict(zip(at, optimiser.step(list(at.values()), [g[k] for k in at])))
    assert history == pytest.approx(losses) and all(np.allclose(at[k], fitted[k], atol=1e-9) for k in at)
    found = {r.k: r.logits for r in selector.scored(df, "k", fitted, heads=2).collect()}
    for k, (c, x, _, m, _) in enumerate(data):
        s, _ = selector.Pass(at, 2, {}).logits(c, x, m)
        assert [y is None for y in found[k]] == (~m).tolist() and [y for y in found[k] if y is not None] == pytest.approx(s[m].tolist(), abs=1e-6)
