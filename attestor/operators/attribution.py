"""Attribution by masking, for any scorer that is handed in.

Each item is scored whole and once for every distinct mask of it; the drop of the
score is the mask's importance.  A part's map value is the mean drop of the masks
that cover it.  Items, masks and scorer are tables and a function of Arrow
batches; what a mask does to an item's parts is a column expression, so the
counterfactual inputs are made by the JVM and only the scorer runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_parts(parts: str, mask: str, fill: str | None = None) -> Column:
    """An array of vectors with the parts that the mask names (places from 0) replaced: by zeros, or by the vector ``fill``."""
    instead = F.col(fill) if fill else F.transform(F.get(F.col(parts), F.lit(0)), lambda _: F.lit(0.0))
    return F.transform(parts, lambda x, i: F.when(F.array_contains(F.col(mask), i), instead).otherwise(x.cast("array<double>")))


def mean_part(parts: str) -> Column:
    """The mean vector of an array of vectors: what a mask is often filled with."""
    total = F.aggregate(F.slice(F.col(parts), 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.transform(F.get(F.col(parts), F.lit(0)), lambda x: x.cast("double")), lambda a, x: F.zip_with(a, x, lambda y, z: y + z.cast("double")))
    return F.transform(total, lambda x: x / F.size(parts))


def drops(items: DataFrame, masks: DataFrame, key: str, scorer, fill: bool = False) -> DataFrame:
    """key, mask (its places, sorted) and drop: score of the whole item minus that of the masked one.

    ``items`` has key and parts (array of vectors); ``masks`` has key and mask
    (array of places).  Masks that cover the same places are one.  ``scorer``
    turns batches of (key, mask, parts) into batches of (key, mask, score).
    """
    kind = dict(items.dtypes)[key]
    whole = F.array().cast("array<int>")
    distinct = masks.select(key, F.array_sort(F.array_distinct(F.col("mask").cast("array<int>"))).alias("mask")).distinct()
    every = distinct.where(F.size("mask") > 0).unionByName(items.select(key, whole.alias("mask")).distinct())
    d = items.select(key, "parts", *([mean_part("parts").alias("_fill")] if fill else [])).join(every, key)
    d = d.select(key, "mask", masked_parts("parts", "mask", "_fill" if fill else None).alias("parts"))
    found = d.mapInArrow(scorer, f"{key} {kind}, mask array<int>, score double")
    per = found.groupBy(key).agg(F.max(F.when(F.size("mask") == 0, F.col("score"))).alias("_whole"), F.collect_list(F.when(F.size("mask") > 0, F.struct("mask", "score"))).alias("_m"))  # an item's masks, a bounded number
    return per.select(key, "_whole", F.explode("_m").alias("m")).select(key, "m.mask", (F.col("_whole") - F.col("m.score")).alias("drop"))


def maps(found: DataFrame, key: str) -> DataFrame:
    """key, place, importance: the mean drop of the masks that cover a place."""
    return found.select(key, F.explode("mask").alias("place"), "drop").groupBy(key, "place").agg(F.avg("drop").alias("importance"))


def region_scores(found_maps: DataFrame, regions: DataFrame, key: str, region: str) -> DataFrame:
    """key, region, score: minus the mean importance of the places of each region (array column ``places``); null without any."""
    d = regions.select(key, region, F.explode_outer("places").alias("place")).join(found_maps, [key, "place"], "left")
    return d.groupBy(key, region).agg((-F.avg("importance")).alias("score"))
