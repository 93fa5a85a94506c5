"""Reproducible samples, ranks and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.hashing import hash_order
from attestor.functions.numeric import col
from attestor.session import stored


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def one_per_group(df: DataFrame, group: str, parts: list[str], seed, n: int | None = None) -> DataFrame:
    """Of each group the row with the smallest salted hash; then, in hash order of the group, the first n.

    An aggregate, not a window: groups of any size are combined before the shuffle.
    """
    h = hash_order(seed, *parts)
    d = df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), h).alias("_r")).select(group, "_r.*")
    return d.orderBy(hash_order(seed, group)).limit(n) if n else d


def first_n(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; the query fails if a group has fewer.

    Rows beyond the nth are dropped before the shuffle; what is left is counted.
    """
    d = ranked(df, [group], [F.col(c) for c in order]).where(F.col("rn") <= n)
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    short = F.raise_error(F.concat(F.lit("too few rows in "), F.col(group).cast("string"))).cast("boolean")
    return d.where(F.when(F.col("_n") >= n, F.lit(True)).otherwise(short)).drop("_n", "rn")


def top_k_by_priority(df: DataFrame, group: str, key: list[str], priority: list[str], k: int) -> DataFrame:
    """The best priority of each key, then the k best keys of each group."""
    d = df.groupBy(group, *key).agg(F.min(F.struct(*priority)).alias("priority"))
    return ranked(d, [group], [F.col("priority"), *[F.col(c) for c in key]]).where(F.col("rn") <= k)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of rows with equal keys the last by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def overriding(earlier: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a later row replaces the earlier one with its keys."""
    return earlier.join(later.select(*keys), keys, "left_anti").unionByName(later)


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def round_robin(df: DataFrame, bin_: str, order: list[Column], n: int) -> DataFrame:
    """Draw from the bins in turn until n rows are taken; exhausted bins are passed over."""
    return ranked(df, [bin_], order).where(F.col("rn") <= n).orderBy("rn", bin_).limit(n)  # no bin gives more than n


def fixed_per_stratum(df: DataFrame, stratum: Column, sizes: dict[str, int], order: list[Column]) -> DataFrame:
    """Exactly so many rows of each stratum; the query fails if one is short, also if it has no row at all."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    d = df.withColumn("stratum", stratum).where(F.col("stratum").isin(*sizes))
    d = ranked(d, ["stratum"], order).where(F.col("rn") <= max(sizes.values()))  # drops rows before the shuffle
    d = d.where(F.col("rn") <= F.element_at(want, F.col("stratum")))
    named = df.sparkSession.createDataFrame([(k, n) for k, n in sizes.items()], "_s string, _w int")
    found = named.join(d.groupBy("stratum").agg(F.count("*").alias("_n")), F.col("_s") == F.col("stratum"), "left")
    short = F.raise_error(F.concat(F.lit("too few rows in stratum "), F.col("_s"))).cast("boolean")
    whole = found.where(F.when(F.coalesce("_n", F.lit(0)) >= F.col("_w"), F.lit(True)).otherwise(short)).select("_s")
    return d.join(F.broadcast(whole), F.col("stratum") == F.col("_s")).drop("_s")  # one row for each name given


def offsets(df: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """start and stop of each row's slice in its group's flat array."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start", before).withColumn("stop", F.col("start") + F.col(size))


def broken_offsets(df: DataFrame, group: str, order: list[str], start: str, stop: str) -> DataFrame:
    """Rows that do not begin where the one before ends, or that end before they begin."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_p", F.lag(stop).over(w)).where((F.col(start) != F.coalesce("_p", F.lit(0))) | (F.col(stop) < F.col(start))).drop("_p")


def shuffled(df: DataFrame, seed, parts: list[str]) -> DataFrame:
    return df.orderBy(hash_order(seed, *parts), *parts)


def by_custom_order(df: DataFrame, column: str, names: list[str], *then) -> DataFrame:
    place = F.array_position(F.lit(names), col(column))
    return df.orderBy(F.when(place == 0, len(names) + 1).otherwise(place), *then)


def unique_picks(df: DataFrame, category: str, owner: str, order: list[Column], each: int, categories: list[str]) -> DataFrame:
    """For each category in turn its first rows whose owner was not picked before, one row per owner.

    Proposals in rounds: every category asks for its first free owners at once,
    and an owner asked for by several goes to the first of them.  What a category
    may ask for depends on earlier ones only, so after k rounds the first k are
    settled; rounds end when none changes.  Others can take at most each x
    categories owners from a category, so no more of its owners are ever looked
    at.  Each round reads and writes small tables; the plan does not grow.
    """
    names = df.columns
    place = F.array_position(F.lit(categories), F.col(category))
    d = ranked(df.where(place > 0).withColumn("_c", place), ["_c", owner], order).where("rn = 1").drop("rn")
    some = stored(ranked(d, ["_c"], order, "_r").where(F.col("_r") <= each * len(categories)), "candidates")
    picks, before = some.where("false"), None
    for _ in range(len(categories) + 1):
        first = picks.groupBy(F.col(owner).alias("_o")).agg(F.min("_c").alias("_t"))
        free = some.join(F.broadcast(first), F.col(owner).eqNullSafe(F.col("_o")), "left").where("_t IS NULL OR _t >= _c").drop("_o", "_t")  # at most each x categories owners
        now = stored(ranked(free, ["_c"], [F.col("_r")]).where(F.col("rn") <= each).drop("rn"), "picks")
        found = {tuple(r) for r in now.select("_c", "_r").collect()}  # at most each x categories pairs of numbers
        picks, settled, before = now, found == before, found
        if settled:
            break
    return picks.orderBy("_c", "_r").select(*names)


def early_exit(df: DataFrame, good: Column, n: int) -> DataFrame:
    """The first n rows, in the order of the table's files, for which ``good`` holds.

    Partitions are read a few at a time until n rows are found, so most of a
    large table is never read; n rows pass the driver.
    """
    return df.sparkSession.createDataFrame(df.where(good).take(n), df.schema)
