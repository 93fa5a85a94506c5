"""Choosing one candidate per group under stated orders and tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.geometry import center_score
from attestor.functions.numeric import col, ratio


def action_metrics(fact_count="fact_count", size=F.size) -> dict[str, Column]:
    """Nine figures of an action from its label columns, lists or, with ``size=F.col``, their sizes; a rate without a denominator is null."""
    new, bad, again = size("new_supported_fact_ids"), size("contradicted_claim_ids"), size("repeated_fact_ids")
    return {
        "delta_coverage": ratio(new, fact_count),
        "new_correct_count": new.cast("double"),
        "uncovered_fact_recall": ratio(new, size("eligible_missing_fact_ids")),
        "invalid_claim_count": bad.cast("double"),
        "invalid_claim_rate": ratio(bad, new + bad),
        "repeat_count": again.cast("double"),
        "repeat_rate": ratio(again, new + again),
        "unknown_claim_count": size("unknown_claim_ids").cast("double"),
        "pixel_cost": F.col("pixel_cost").cast("double"),
    }


METRICS = ["delta_coverage", "new_correct_count", "uncovered_fact_recall", "invalid_claim_count", "invalid_claim_rate", "repeat_count", "repeat_rate", "unknown_claim_count", "pixel_cost"]


def place(id_, *keys) -> Column:
    """What candidates are ordered by: the keys, then the id."""
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], col(id_).alias("id"))


def largest_id_wins(id_, *keys) -> Column:
    """Aggregate: id of the greatest keys; of equals the largest id."""
    return F.max_by(col(id_), place(id_, *keys))


def smallest_id_wins(id_, *keys) -> Column:
    """Aggregate: id of the least keys; of equals the smallest id."""
    return F.min_by(col(id_), place(id_, *keys))


def first_wins(id_, score, order) -> Column:
    """Aggregate: id of the greatest score; of equals the first in order."""
    return F.min_by(col(id_), F.struct((-col(score)).alias("s"), col(order).alias("o")))


#: Orders of the deployable policies and of the oracle: greatest keys win, then the largest id.
POLICIES = {
    "recognition_oracle": lambda: (F.coalesce("delta_coverage", F.lit(-1.0)), -F.col("invalid_claim_count"), -F.col("pixel_cost")),
    "largest_area": lambda: (F.col("pixel_cost"),),
    "proposal_score": lambda: (F.coalesce("proposal_score", F.lit(float("-inf"))),),
    "center": lambda: (center_score("boxes", "width", "height"),),
    "stop": lambda: ((F.col("kind") == "stop").cast("int"),),
}


def chosen(rows: DataFrame, group: list[str], id_: str, policies: dict | None = None) -> DataFrame:
    """group, method, id: what each policy chooses in each group, in one pass over the rows."""
    policies = policies or POLICIES
    d = rows.groupBy(*group).agg(*[largest_id_wins(id_, *keys()).alias(name) for name, keys in policies.items()])
    return d.unpivot(group, list(policies), "method", id_)


def expected_random(rows: DataFrame, group: list[str], *more: Column) -> DataFrame:
    """Mean figures of a random choice, and ``more`` aggregates; rates are ratios of means, not means of ratios."""
    d = rows.groupBy(*group).agg(*[F.avg(m).alias(m) for m in METRICS], *more)
    n, bad, again = F.col("new_correct_count"), F.col("invalid_claim_count"), F.col("repeat_count")
    return d.withColumns({"invalid_claim_rate": ratio(bad, n + bad), "repeat_rate": ratio(again, n + again)})


def best_static(rows: DataFrame, parent: str, group: str, id_: str, value: str) -> DataFrame:
    """parent, id: the one candidate that does best over all groups of a parent; of equals the largest id."""
    per = rows.groupBy(parent, id_).agg(F.sum(value).alias("_total"))
    return per.groupBy(parent).agg(largest_id_wins(id_, "_total").alias(id_))


def family_best(rows: DataFrame, families: DataFrame, groups: DataFrame, group: str, family: str, value: str) -> DataFrame:
    """Best value in each family (a table with that column) for each group; a family without a candidate counts 0.

    The names of the families, a few, travel as one array, which each group's
    row unfolds; there is no grid to join.
    """
    names = F.broadcast(families.agg(F.array_sort(F.collect_set(family)).alias("_names")))  # one row
    best = rows.groupBy(group, family).agg(F.max(value).alias("_v")).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(family, "_v"))).alias("_best"))
    d = groups.select(group).distinct().join(best, group, "left").crossJoin(names)
    d = d.select(group, F.explode("_names").alias(family), "_best")
    return d.select(group, family, F.coalesce(F.try_element_at("_best", F.col(family)), F.lit(0)).alias(value))
