"""Vectors as array columns; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.numeric import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: inside a lambda a plain expression is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v) -> Column:
    """v / |v|; null for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(F.arrays_zip(col(v).alias("x"), F.array_repeat(n, F.size(col(v))).alias("n")), lambda p: p["x"].cast("double") / p["n"]))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def inverse_cosine(a, b) -> Column:
    return (F.lit(1.0) - cosine(a, b)) * 0.5


def product(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))


def mean_components(v, size: int) -> list[Column]:
    """Aggregates whose array is the mean vector of a group: one mean for each place."""
    return [F.avg(col(v)[k].cast("double")) for k in range(size)]


def top_label(probabilities) -> Column:
    """Label of the largest probability in a map; of equals the first in order."""
    entries = F.transform(F.map_entries(col(probabilities)), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def symmetric_margin(forward, swapped) -> Column:
    """Mean of a margin and of the margin with the codes swapped, turned back."""
    return (col(forward) - col(swapped)) / 2.0


def log_softmax(logits, mask) -> Column:
    """Log-softmax over the places where the mask is true; null elsewhere."""
    x = F.transform(F.arrays_zip(col(logits).alias("x"), col(mask).alias("m")), lambda p: F.when(p["m"], p["x"].cast("double")))

    def of(v: Column) -> Column:
        def shifted(top: Column) -> Column:
            total = F.aggregate(v, F.lit(0.0), lambda s, y: s + F.coalesce(F.exp(y - top), F.lit(0.0)))
            return bound(total, lambda t: F.transform(v, lambda y: y - top - F.log(t)))

        return bound(F.array_max(v), shifted)

    return bound(x, of)
