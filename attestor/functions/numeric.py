"""Numbers with explicit rules for null, NaN, zero denominators and ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, or null if it is null, NaN or infinite."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_mean(c) -> Column:
    """Mean of finite values; null if there is none."""
    return F.avg(finite(c))


def ratio(a, b) -> Column:
    """a / b as double, null where b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_or_zero(a, b) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def kappa(agreed, chance) -> Column:
    """Cohen's kappa; null if chance agreement is complete."""
    return F.when(col(chance) < 1, (col(agreed) - col(chance)) / (1 - col(chance)))


def expected_top1(higher, tied) -> Column:
    """Chance that a target is first, with ties broken at random: tied counts the target itself."""
    return F.when(col(higher) == 0, F.lit(1.0) / col(tied)).otherwise(0.0)


def expected_reciprocal_rank(higher, tied) -> Column:
    """Mean of 1 / rank over the ranks that a tied target may take."""
    places = F.sequence(F.lit(1), col(tied).cast("int"))
    return F.aggregate(places, F.lit(0.0), lambda a, k: a + F.lit(1.0) / (col(higher) + k)) / col(tied)


def scaled(delta, scale, least: float = 1e-8) -> Column:
    """delta / scale, 0 where the scale is next to nothing."""
    return F.when(col(scale) > least, col(delta) / col(scale)).otherwise(0.0)


def jaccard(a, b) -> Column:
    """Jaccard of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / F.nullif(union, F.lit(0)))


def index_quantile(values, p: float) -> Column:
    """Element int(n * p) of the sorted array: a quantile without interpolation."""
    return F.element_at(F.array_sort(col(values)), F.floor(F.size(col(values)) * p).cast("int") + 1)
