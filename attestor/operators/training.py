"""Training of small scorers, data-parallel: tasks add up gradients, the driver takes the step.

A scorer looks at a region's vector v and a caption's vector t through
[v, t, v * t, |v - t|], one hidden layer with ReLU, and a sigmoid.  Losses are
means over regions of up to three captions each (matched, complete, control):

* margin: the target's score under the caption that omits it exceeds its score
  under the complete one by a margin;
* locality: other regions' scores do not move between the two captions;
* control: the target's score does not move under a control caption;
* bce: targets score 1 under the omitting caption, all others 0.

An epoch is one pass: each task turns its rows into one row of gradient sums, so
what is shuffled does not depend on the number of rows.  Steps are AdamW's with
its usual constants.  The epoch that does best on the validation rows is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import ship, stored

#: Size of the hidden layer, margin, AdamW's constants, epochs and how often they are validated.
HIDDEN, MARGIN, RATE, DECAY, BETAS, EPS, EPOCHS, EVERY = 128, 0.1, 1e-3, 0.01, (0.9, 0.999), 1e-8, 60, 5
#: Which losses each mode adds up, and which side it does not see.
MODES = {
    "rank": ("margin",), "rank_local": ("margin", "locality"), "rank_local_control": ("margin", "locality", "control"),
    "supervised_omission": ("bce",), "text_only": ("margin", "locality", "control"), "image_only": ("margin", "locality", "control"),
}
CAPTIONS = ("omitting", "complete", "control")


@dataclass
class Weights:
    """w1 [hidden, 4 width], b1, w2 [hidden], b2."""

    parts: list[np.ndarray]
    best_epoch: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @staticmethod
    def start(width: int, seed: int, hidden: int = HIDDEN) -> Weights:
        """Uniform within 1 / sqrt(inputs) of each layer."""
        draw = np.random.default_rng(seed)
        sizes = [((hidden, 4 * width), 4 * width), ((hidden,), 4 * width), ((hidden,), hidden), ((1,), hidden)]
        return Weights([draw.uniform(-1, 1, shape) / np.sqrt(n) for shape, n in sizes])


def scores(parts: list[np.ndarray], v: np.ndarray, t: np.ndarray, mode: str):
    """Scores of rows, and what the gradient needs."""
    v = np.zeros_like(v) if mode == "text_only" else v
    t = np.zeros_like(t) if mode == "image_only" else t
    x = np.concatenate((v, t, v * t, np.abs(v - t)), 1)
    h = x @ parts[0].T + parts[1]
    a = np.maximum(h, 0)
    return 1 / (1 + np.exp(-(a @ parts[2] + parts[3][0]))), (x, h, a)


def gradient(parts: list[np.ndarray], held, q: np.ndarray, dq: np.ndarray) -> list[np.ndarray]:
    """Sums over rows of the derivatives by the weights, given those by the scores."""
    x, h, a = held
    z = dq * q * (1 - q)
    inner = np.outer(z, parts[2]) * (h > 0)
    return [inner.T @ x, inner.sum(0), a.T @ z, np.array([z.sum()])]


def loss_and_gradient(parts: list[np.ndarray], v, captions, target: np.ndarray, mode: str, n_target: int, n_other: int):
    """A part's share of the loss, and of its gradient, as one flat array."""
    q, held = zip(*(scores(parts, v, t, mode) for t in captions))
    d, loss, other = [np.zeros(len(v)) for _ in q], 0.0, ~target
    used = MODES[mode]
    if "bce" in used:
        n = max(1, n_target + n_other)
        low, high = (np.clip(x, 1e-12, 1 - 1e-12) for x in q[:2])
        loss += -(np.log(low[target]).sum() + np.log(1 - low[other]).sum() + np.log(1 - high).sum()) / n
        d[0] += np.where(target, -1 / low, 1 / (1 - low)) / n
        d[1] += 1 / (1 - high) / n
    if "margin" in used and n_target:
        gap = MARGIN - q[0] + q[1]
        open_ = target & (gap > 0)
        loss += gap[open_].sum() / n_target
        d[0] -= open_ / n_target
        d[1] += open_ / n_target
    for name, rows, (i, j), n in (("locality", other, (0, 1), n_other), ("control", target, (2, 1), n_target)):
        if name in used and n:
            move = np.where(rows, q[i] - q[j], 0.0)
            loss += np.abs(move).sum() / n
            d[i] += np.sign(move) / n
            d[j] -= np.sign(move) / n
    total = [sum(g) for g in zip(*(gradient(parts, h, x, y) for h, x, y in zip(held, q, d)))]
    return loss, np.concatenate([g.ravel() for g in total])


def unflat(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([p.size for p in like])[:-1]
    return [x.reshape(p.shape) for x, p in zip(np.split(flat, cuts), like)]


class AdamW:
    """Decoupled weight decay, then the step by corrected moments."""

    def __init__(self, like: list[np.ndarray]):
        self.m, self.s, self.n = [np.zeros_like(p) for p in like], [np.zeros_like(p) for p in like], 0

    def step(self, parts: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        self.n += 1
        out = []
        for k, (p, g) in enumerate(zip(parts, grads)):
            self.m[k] = BETAS[0] * self.m[k] + (1 - BETAS[0]) * g
            self.s[k] = BETAS[1] * self.s[k] + (1 - BETAS[1]) * g * g
            m, s = self.m[k] / (1 - BETAS[0] ** self.n), self.s[k] / (1 - BETAS[1] ** self.n)
            out.append(p * (1 - RATE * DECAY) - RATE * m / (np.sqrt(s) + EPS))
        return out


def _matrices(batch) -> tuple[np.ndarray, list[np.ndarray]]:
    x = [np.asarray(batch.column(k).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for k in ("v", *CAPTIONS)]
    return x[0], x[1:]


def _pass(rows: DataFrame, parts: list[np.ndarray], mode: str, n_target: int, n_other: int) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows."""
    size = sum(p.size for p in parts)

    def run(batches):
        loss, total = 0.0, np.zeros(size)
        for b in batches:
            if b.num_rows:
                v, captions = _matrices(b)
                part, g = loss_and_gradient(parts, v, captions, b.column("target").to_numpy(zero_copy_only=False).astype(bool), mode, n_target, n_other)
                loss, total = loss + part, total + g
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["loss", "g"])

    found = rows.select("v", *CAPTIONS, "target").mapInArrow(run, "loss double, g array<double>").toArrow()  # one row for each task
    return float(np.sum(found["loss"].to_numpy())), np.sum(np.array(found["g"].to_pylist()).reshape(-1, size), axis=0)


def scored(rows: DataFrame, weights: Weights, mode: str) -> DataFrame:
    """The rows' id, image and target with a score for each caption."""
    ship(rows.sparkSession)
    parts = weights.parts

    def run(batches):
        for b in batches:
            if b.num_rows:
                v, captions = _matrices(b)
                q = [scores(parts, v, t, mode)[0] for t in captions]
                yield pa.RecordBatch.from_arrays([b.column("image"), b.column("region"), b.column("target"), *map(pa.array, q)], ["image", "region", "target", *CAPTIONS])

    return rows.select("image", "region", "target", "v", *CAPTIONS).mapInArrow(run, "image string, region string, target boolean, omitting double, complete double, control double")


def first_gain(found: DataFrame) -> float:
    """Mean over images of how much likelier the target is ranked first under the omitting caption than under the complete one; ties share."""
    def first(c):
        t = F.max(F.when(F.col("target"), F.col(c)))
        return t, F.array_sort(F.collect_list(c))

    d = found.groupBy("image").agg(*[x.alias(f"{c}_{k}") for c in CAPTIONS[:2] for k, x in zip("tl", first(c))])
    share = lambda c: F.when(F.col(f"{c}_t") == F.array_max(f"{c}_l"), 1.0 / F.size(F.filter(f"{c}_l", lambda x: x == F.col(f"{c}_t")))).otherwise(0.0)
    return d.where(F.col("omitting_t").isNotNull()).agg(F.avg(share("omitting") - share("complete"))).first()[0] or 0.0


def fit(train: DataFrame, validation: DataFrame, width: int, mode: str = "rank_local_control", seed: int = 0, epochs: int = EPOCHS, every: int = EVERY, hidden: int = HIDDEN, figure=first_gain) -> Weights:
    """Weights of the best epoch by ``figure`` on the validation rows (the first of equals).

    Rows have image, region, target, and vectors v, omitting, complete, control.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    ship(train.sparkSession)
    columns = ["image", "region", "target", "v", *CAPTIONS]
    train, validation = stored(train.select(*columns), "train"), stored(validation.select(*columns), "validation")
    n_target, n_other = train.agg(F.count_if("target"), F.count_if(~F.col("target"))).first()
    at = Weights.start(width, seed, hidden)
    optimiser, best, kept, history = AdamW(at.parts), -np.inf, at, []
    for epoch in range(1, epochs + 1):
        loss, g = _pass(train, at.parts, mode, n_target, n_other)
        at = Weights(optimiser.step(at.parts, unflat(g, at.parts)))
        if epoch % every == 0 or epoch == epochs:
            value = figure(scored(validation, at, mode))
            history.append((epoch, loss, value))
            if value > best:
                best, kept = value, Weights(at.parts, epoch)
    return Weights(kept.parts, kept.best_epoch, history)
