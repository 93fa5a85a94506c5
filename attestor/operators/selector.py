"""A set-valued selector: candidates of one list look at each other and are scored together, in no order.

A candidate's token is a linear map of its features plus one of its context's.
Layers normalise, attend over the list's valid candidates with several heads, and
pass through a GELU layer four times as wide, each with a way around; a last
normalisation and a linear map give the logit.  There are no positions, so scores
move with their candidates.

The loss of a list is the cross entropy to the uniform distribution over its
positives; lists of paraphrases add the symmetric divergence of their
distributions.  Training is data-parallel: tasks sum gradients over their lists,
the driver takes AdamW's steps.  A list, one row, holds a bounded number of
candidates by its nature.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.training import AdamW
from attestor.session import ship, stored

_erf = np.frompyfunc(math.erf, 1, 1)


def start(candidate: int, context: int, hidden: int = 256, layers: int = 2, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights by name; linear maps are uniform within 1 / sqrt(inputs)."""
    draw, out = np.random.default_rng(seed), {}

    def linear(name, rows, columns):
        out[f"{name}.w"], out[f"{name}.b"] = (draw.uniform(-1, 1, shape) / math.sqrt(columns) for shape in ((rows, columns), (rows,)))

    def norm(name):
        out[f"{name}.g"], out[f"{name}.o"] = np.ones(hidden), np.zeros(hidden)

    linear("candidate", hidden, candidate)
    linear("context", hidden, context)
    for k in range(layers):
        norm(f"{k}.first")
        linear(f"{k}.qkv", 3 * hidden, hidden)
        linear(f"{k}.out", hidden, hidden)
        norm(f"{k}.second")
        linear(f"{k}.up", 4 * hidden, hidden)
        linear(f"{k}.down", hidden, 4 * hidden)
    norm("last")
    linear("score", 1, hidden)
    return out


class Pass:
    """One forward pass over a list and its way back; gradients add up in ``grads``."""

    def __init__(self, weights: dict[str, np.ndarray], heads: int, grads: dict[str, np.ndarray] | None = None):
        self.w, self.heads, self.grads = weights, heads, {k: np.zeros_like(v) for k, v in weights.items()} if grads is None else grads

    def linear(self, name: str, x: np.ndarray):
        w = self.w[f"{name}.w"]

        def back(d):
            self.grads[f"{name}.w"] += d.T @ x
            self.grads[f"{name}.b"] += d.sum(0)
            return d @ w

        return x @ w.T + self.w[f"{name}.b"], back

    def norm(self, name: str, x: np.ndarray):
        g = self.w[f"{name}.g"]
        centred = x - x.mean(1, keepdims=True)
        scale = np.sqrt((centred**2).mean(1, keepdims=True) + 1e-5)
        unit = centred / scale

        def back(d):
            self.grads[f"{name}.g"] += (d * unit).sum(0)
            self.grads[f"{name}.o"] += d.sum(0)
            u = d * g
            return (u - u.mean(1, keepdims=True) - unit * (u * unit).mean(1, keepdims=True)) / scale

        return unit * g + self.w[f"{name}.o"], back

    def attend(self, name: str, x: np.ndarray, valid: np.ndarray):
        n, width = x.shape
        size = width // self.heads
        qkv, qkv_back = self.linear(f"{name}.qkv", x)
        q, k, v = (qkv[:, i * width : (i + 1) * width].reshape(n, self.heads, size).transpose(1, 0, 2) for i in range(3))
        logits = q @ k.transpose(0, 2, 1) / math.sqrt(size)
        logits[:, :, ~valid] = -np.inf
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        out, out_back = self.linear(f"{name}.out", (p @ v).transpose(1, 0, 2).reshape(n, width))

        def back(d):
            dm = out_back(d).reshape(n, self.heads, size).transpose(1, 0, 2)
            dp = dm @ v.transpose(0, 2, 1)
            dl = p * (dp - (dp * p).sum(2, keepdims=True)) / math.sqrt(size)
            parts = [dl @ k, dl.transpose(0, 2, 1) @ q, p.transpose(0, 2, 1) @ dm]
            return qkv_back(np.concatenate([y.transpose(1, 0, 2).reshape(n, width) for y in parts], 1))

        return out, back

    def logits(self, candidates: np.ndarray, context: np.ndarray, valid: np.ndarray):
        """Logits of a list's candidates, -inf where not valid, and the way back from their derivatives."""
        x, candidate_back = self.linear("candidate", candidates)
        c, context_back = self.linear("context", context[None, :])
        x = x + c
        ways, layers = [], sum(k.endswith(".qkv.w") for k in self.w)
        for k in range(layers):
            y, b1 = self.norm(f"{k}.first", x)
            y, b2 = self.attend(str(k), y, valid)
            x = x + y
            y, b3 = self.norm(f"{k}.second", x)
            u, b4 = self.linear(f"{k}.up", y)
            half = 0.5 * (1 + _erf(u / math.sqrt(2)).astype(float))
            y, b5 = self.linear(f"{k}.down", u * half)
            x = x + y
            ways.append((b1, b2, b3, b4, b5, half + u * np.exp(-u * u / 2) / math.sqrt(2 * math.pi)))
        y, last_back = self.norm("last", x)
        s, score_back = self.linear("score", y)

        def back(d):
            g = last_back(score_back(np.where(valid, d, 0.0)[:, None]))
            for b1, b2, b3, b4, b5, slope in reversed(ways):
                g = g + b3(b4(b5(g) * slope))
                g = g + b1(b2(g))
            candidate_back(g)
            context_back(g.sum(0, keepdims=True))

        return np.where(valid, s[:, 0], -np.inf), back


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x[np.isfinite(x)].max()
    with np.errstate(invalid="ignore"):
        return x - top - np.log(np.exp(x - top).sum())


def list_loss(logits: np.ndarray, positive: np.ndarray, valid: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy to the uniform distribution over the positives, and its derivative by the logits."""
    y = positive & valid
    if not y.any():
        raise ValueError("a list needs a positive candidate")
    p = log_softmax(logits)
    return float(-p[y].mean()), np.where(valid, np.exp(p) - y / y.sum(), 0.0)


def divergence(left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of both Kullback-Leibler divergences, and its derivatives by both logits."""
    a, b = log_softmax(left)[valid], log_softmax(right)[valid]
    p, q = np.exp(a), np.exp(b)
    value, out = 0.5 * float(((p - q) * (a - b)).sum()), []
    for u, v, x, y in ((p, q, a, b), (q, p, b, a)):
        inner = u * (x - y)  # of KL(u, v) by u's logits, and of KL(v, u) by them
        d = np.zeros(len(valid))
        d[valid] = 0.5 * (inner - u * inner.sum() + u - v)
        out.append(d)
    return value, *out


COLUMNS = ["candidates", "context", "positive", "valid", "twin", "has_twin"]


def _lists(batch):
    """Each list's candidates, context, positives, valid places and, where there is one, its paraphrase's context."""
    for c, x, y, m, twin, has in zip(*(batch.column(k).to_pylist() for k in COLUMNS)):
        yield np.array(c, float), np.array(x, float), np.array(y, bool), np.array(m, bool), np.array(twin, float) if has else None


def list_gradient(weights: dict, heads: int, lists, n: int, n_twins: int) -> tuple[float, dict]:
    """Loss and gradient of some lists: their shares of the means over n lists and n_twins paraphrases."""
    p, loss = Pass(weights, heads), 0.0
    for candidates, context, positive, valid, twin in lists:
        x, back = p.logits(candidates, context, valid)
        value, d = list_loss(x, positive, valid)
        loss, d = loss + value / n, d / n
        if twin is not None:
            y, twin_back = p.logits(candidates, twin, valid)
            value, dx, dy = divergence(x, y, valid)
            loss, d = loss + value / n_twins, d + dx / n_twins
            twin_back(dy / n_twins)
        back(d)
    return loss, p.grads


def prepared(rows: DataFrame) -> DataFrame:
    """Lists with columns candidates, context, positive, valid, and twin_context (or null)."""
    twin = F.col("twin_context") if "twin_context" in rows.columns else F.lit(None).cast("array<double>")
    return rows.select("candidates", "context", "positive", "valid", F.coalesce(twin, F.col("context")).alias("twin"), twin.isNotNull().alias("has_twin"))


def fit(rows: DataFrame, weights: dict[str, np.ndarray], heads: int = 4, epochs: int = 20) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after so many steps, and the loss before each."""
    ship(rows.sparkSession)
    lists = stored(prepared(rows), "lists")
    n, n_twins = lists.agg(F.count("*"), F.count_if("has_twin")).first()
    names, history = list(weights), []
    optimiser = AdamW(list(weights.values()))
    for _ in range(epochs):
        at = weights

        def run(batches, at=at):
            loss, total = 0.0, np.zeros(sum(w.size for w in at.values()))
            for b in batches:
                part, g = list_gradient(at, heads, _lists(b), n, n_twins)
                loss, total = loss + part, total + np.concatenate([g[k].ravel() for k in names])
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["loss", "g"])

        found = lists.mapInArrow(run, "loss double, g array<double>").toArrow()  # one row for each task
        flat = np.sum([np.array(g) for g in found["g"].to_pylist()], axis=0)
        history.append(float(np.sum(found["loss"].to_numpy())))
        cuts = np.cumsum([weights[k].size for k in names])[:-1]
        grads = [x.reshape(weights[k].shape) for k, x in zip(names, np.split(flat, cuts))]
        weights = dict(zip(names, optimiser.step([weights[k] for k in names], grads)))
    return weights, history


def scored(rows: DataFrame, key: str, weights: dict[str, np.ndarray], heads: int = 4) -> DataFrame:
    """key and the logits of its list's candidates, null where not valid."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            out = []
            for c, x, m in zip(*(b.column(k).to_pylist() for k in ("candidates", "context", "valid"))):
                s, _ = Pass(weights, heads, {}).logits(np.array(c, float), np.array(x, float), np.array(m, bool))
                out.append([float(y) if ok else None for y, ok in zip(s, m)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "logits"])

    return rows.select(key, "candidates", "context", "valid").mapInArrow(run, f"{key} {kind}, logits array<double>")
