"""Language identification by sparse multinomial logistic regression.

Features are character n-grams of one to three letters (other characters count
as one space), hashed to ``DIMS`` columns for each order, weighted by TF-IDF:
share of the text's n-grams times log inverse document frequency.  Document
frequencies are counted over all training documents.  Weights are trained by
follow-the-regularised-leader with elastic-net penalties on about ``SAMPLE``
documents, taken in equal number from each language by a hash of the id, a
documented bound; a fifth of them is kept from training to choose the penalties
(the strongest pair that is as accurate as the best one, up to TOLERANCE) and to
calibrate the temperature.

Training sees text and non-null lang of documents whose crc32(doc_id) mod 4 is
not 2.  Prediction sees text alone.

Defined results: null text, and text without a letter, gives ``und`` with score
0; with no training document every row is ``und``; whole texts count, however
long; ties go to the first language in sorted order; equal rows give equal
rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, lean, ship, slices

ORDERS, DIMS = (1, 2, 3), 1 << 14
#: Bound of the labelled sample that weights are trained on.
SAMPLE = 2_400
EPOCHS, ALPHA, BETA = 4, 1.0, 1.0
#: Elastic-net penalties to choose from, the sparsest first, and how much of the held-back accuracy the choice may cost.
PENALTIES, TOLERANCE = [(0.1, 0.1), (0.03, 0.03), (0.01, 0.01), (0.003, 0.003), (0.001, 0.001), (1e-5, 1e-6)], 0.002
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def columns(text: pa.Array):
    """Start of each text among the batch's code points, its length and letters, and for each order the column at each position."""
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.string()), ""))
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[x]
    x = np.where(letter, x, np.uint32(32))
    stops = np.cumsum(sizes)
    count = np.concatenate(([0], np.cumsum(letter)))
    hashed, h = [], np.zeros(len(x), np.uint32)
    for k, n in enumerate(ORDERS):
        h = h[: max(0, len(x) - n + 1)] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        hashed.append((mixed >> np.uint32(18)).astype(np.int32) + k * DIMS)
    return stops - sizes, sizes, count[stops] - count[stops - sizes], hashed


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each column, over all of ``docs``; each task adds up its own before the shuffle."""

    def count(batches):
        total, n = np.zeros(len(ORDERS) * DIMS, np.int64), 0
        some, held = np.zeros(len(total), np.uint16), 0  # narrow sums are added up fast
        for whole in batches:
            for part in slices(whole, 8 << 20):
                starts, sizes, _, hashed = columns(part.column(0))
                n += len(starts)
                seen = np.empty(len(total), bool)
                for a, size in zip(starts.tolist(), sizes.tolist()):
                    seen[:] = False
                    for order, h in zip(ORDERS, hashed):
                        seen[h[a : max(a, a + size - order + 1)]] = True
                    some += seen
                    held += 1
                    if held == 60_000:
                        total += some
                        some[:], held = 0, 0
        total += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["at", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(ORDERS) * DIMS + 1, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def sampled(train: DataFrame, bound: int) -> DataFrame:
    """About bound / languages rows of each language, those with the smallest hashes of the id."""
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train.limit(0)
    each = max(10, bound // len(sizes))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])[F.col("lang")]
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return train.where(place < share)


def vectors(docs: DataFrame) -> pa.Table:
    """lang, place (a hash of the id), and the term shares of each document."""

    def run(batches):
        for whole in batches:
            for part in slices(whole, 8 << 20):
                starts, sizes, _, hashed = columns(part.column(2))
                at, value = [], []
                for a, size in zip(starts.tolist(), sizes.tolist()):
                    found = [np.unique(h[a : max(a, a + size - n + 1)], return_counts=True) for n, h in zip(ORDERS, hashed)]
                    at.append(np.concatenate([k for k, _ in found]).astype(np.int32))
                    value.append(np.concatenate([c / max(1, c.sum()) for _, c in found]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "place", "at", "value"])

    d = docs.select("lang", F.xxhash64(F.col("doc_id"), F.lit("order")).alias("place"), "text")
    return d.mapInArrow(lean(run), "lang string, place long, at array<int>, value array<float>").toArrow()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int, l1: float, l2: float) -> np.ndarray:
    """Weights [width + 1, classes] by FTRL-proximal steps, one for each document; the last row is the bias."""
    z, n, w = np.zeros((width + 1, classes)), np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
    for _ in range(EPOCHS):
        for at, value, y in rows:
            zi, ni = z[at], n[at]
            shrunk = np.sign(zi) * l1 - zi
            wi = np.where(np.abs(zi) <= l1, 0.0, shrunk / ((BETA + np.sqrt(ni)) / ALPHA + l2))
            w[at] = wi
            p = softmax(value @ wi)
            p[y] -= 1
            g = value[:, None] * p
            new = ni + g * g
            z[at] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / ALPHA * wi
            n[at] = new
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the held-back labels likeliest, from a grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def chosen(rows, back, y: np.ndarray, classes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights under the strongest penalties that are as accurate on held-back rows as the best, and the logits of these."""
    tried = []
    for l1, l2 in PENALTIES if len(back) else PENALTIES[-1:]:
        w = ftrl(rows, classes, width, l1, l2)
        logits = np.array([v @ w[a] for a, v, _ in back]).reshape(len(back), classes)
        tried.append((float((logits.argmax(1) == y).mean()) if len(back) else 0.0, w, logits))
    best = max(x[0] for x in tried)
    return next((w, logits) for right, w, logits in tried if right >= best - TOLERANCE)


def zero_share(weights: np.ndarray) -> float:
    """Share of zeros among the weights of columns that some text has reached."""
    used = weights[(weights != 0).any(1)]
    return float((used == 0).mean()) if len(used) else 1.0


def fit(docs: DataFrame, bound: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights of each column (idf and temperature included), and biases."""
    ship(docs.sparkSession)
    train = docs.select("doc_id", "text", "lang").where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    found = vectors(sampled(train, bound))
    langs = sorted(set(found["lang"].to_pylist()))
    order = np.argsort(found["place"].to_numpy(), kind="stable")
    label, at, value = found["lang"].to_pylist(), found["at"].to_pylist(), found["value"].to_pylist()
    rows = []
    for k in order.tolist():
        a = np.array([*at[k], len(idf)])
        rows.append((a, np.append(np.array(value[k]) * idf[a[:-1]], 1.0), langs.index(label[k])))
    back = [r for k, r in enumerate(rows) if k % 5 == 4]
    rows, y = [r for k, r in enumerate(rows) if k % 5 != 4], np.array([y for *_, y in back], int)
    w, logits = chosen(rows, back, y, max(1, len(langs)), len(idf))
    t = temperature(logits, y)
    return langs, (w[:-1] * idf[:, None] / t).astype(np.float32), w[-1] / t


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of each document, from its text alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, weights, bias = shared.value
        for whole in batches:
            for part in slices(whole, 4 << 20):
                starts, sizes, n_letters, hashed = columns(part.column(1))
                logits = np.tile(bias, (len(starts), 1))
                for n, h in zip(ORDERS, hashed):
                    some = np.flatnonzero(sizes >= n) if len(h) else np.zeros(0, int)
                    if not len(some):
                        continue
                    a, b = starts[some], starts[some] + sizes[some] - n + 1
                    cuts = np.column_stack((a, np.minimum(b, len(h) - 1))).ravel()
                    for c in range(len(langs)):
                        sums = np.add.reduceat(weights[:, c][h].astype(np.float64), cuts)[::2]
                        if b[-1] == len(h):  # the last text ends with the batch
                            sums[-1] = weights[:, c][h[a[-1] :]].astype(np.float64).sum()
                        logits[some, c] += sums / (sizes[some] - n + 1)
                known = (n_letters > 0) & bool(langs)
                p = softmax(logits) if langs else np.zeros((len(starts), 1))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], pa.string()), pa.array(np.where(known, p[np.arange(len(p)), best], 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
