"""Figures of all pairs of vectors of a group, without writing pairs.

Counts and means follow from sums: the dot products of all pairs add up to half
of |sum of vectors|^2 minus the sum of squared lengths.

For the greatest dot product, vectors are dealt into blocks of those on the same
sides of a few fixed planes.  A block knows its centre c, its radius r and the
best pair within.  No pair of two blocks can exceed
c1 c2 + r1 |c2| + r2 |c1| + r1 r2, so only pairs of blocks whose bound is above
the best pair known within any block of the group are multiplied, as matrices,
and each multiplication gives one number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.numeric import col
from attestor.session import ship, stored

#: Vectors of a block, and planes that tell blocks apart.
BLOCK, PLANES = 1_024, 6


def planes(width: int) -> np.ndarray:
    """Fixed directions, one row for each plane."""
    return np.random.default_rng(17).standard_normal((PLANES, width))


def matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), -1)


def sides(vector: str, width: int):
    """On which side of each plane a vector lies, as one number."""
    out = F.lit(0)
    for k, p in enumerate(planes(width).tolist()):
        dot = F.aggregate(F.zip_with(col(vector), F.lit(p), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        out = out + F.when(dot > 0, 1 << k).otherwise(0)
    return out


def pair_figures(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, pairs, mean_dot of all unordered pairs of a group's rows; groups of one row have none."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = Summarizer.metrics("sum", "normL2").summary(array_to_vector(F.col(vector).cast("array<double>")))
    d = df.where(F.col(vector).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), s.alias("s")).where("n > 1")
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return d.select(group, pairs.cast("long").alias("pairs"), ((square(F.col("s.sum")) - square(F.col("s.normL2"))) / 2 / pairs).alias("mean_dot"))


def blocks(df: DataFrame, group: str, key: str, vector: str, size: int) -> DataFrame:
    """Stored: group, block, centre, radius, the best dot product within, and the block's matrix as bytes."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    width = rows.select(F.size("v").alias("w")).first()
    rows = rows.withColumn("side", sides("v", width.w if width else 1))
    many = rows.groupBy("g", "side").agg(F.ceil(F.count("*") / size).alias("parts")).withColumnsRenamed({"g": "_g", "side": "_s"})
    dealt = rows.join(many, F.col("g").eqNullSafe(F.col("_g")) & (F.col("side") == F.col("_s"))).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))

    def sum_up(t: pa.Table) -> pa.Table:
        x = matrix(t["v"])
        c = x.mean(0)
        best = None
        if len(x) > 1:
            dots = x @ x.T
            np.fill_diagonal(dots, -np.inf)
            best = float(dots.max())
        return pa.table({"g": t["g"].slice(0, 1), "side": t["side"].slice(0, 1), "part": t["part"].slice(0, 1), "centre": pa.array([c.tolist()], pa.list_(pa.float64())),
                         "radius": [float(np.sqrt(((x - c) ** 2).sum(1).max()))], "best": pa.array([best], pa.float64()), "x": pa.array([x.tobytes()], pa.binary())})

    kind = dict(rows.dtypes)["g"]
    out = dealt.select("g", "side", "part", "v").groupBy("g", "side", "part").applyInArrow(sum_up, f"g {kind}, side int, part long, centre array<double>, radius double, best double, x binary")
    return stored(out.withColumn("block", F.concat_ws(":", F.col("side").cast("string"), F.col("part").cast("string"))), "blocks")


def best_dot(df: DataFrame, group: str, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """group and the greatest dot product of two of its rows; groups of one row have none."""
    ship(df.sparkSession)
    b = blocks(df, group, key, vector, size)
    known = b.groupBy("g").agg(F.max("best").alias("best"))
    short = b.select("g", "block", "centre", "radius")
    left, right = (short.select(F.col("g").alias(f"g{s}"), F.col("block").alias(f"b{s}"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}")) for s in "lr")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    bound = dot(F.col("cl"), F.col("cr")) + F.col("rl") * norm("cr") + F.col("rr") * norm("cl") + F.col("rl") * F.col("rr")
    pairs = left.join(right, F.col("gl").eqNullSafe(F.col("gr")) & (F.col("bl") < F.col("br")))
    pairs = pairs.join(known.withColumnRenamed("g", "gk"), F.col("gl").eqNullSafe(F.col("gk"))).where(F.col("best").isNull() | (bound > F.col("best") - 1e-9))
    x = b.select("g", "block", "x", F.size("centre").alias("w"))
    for s in "lr":
        pairs = pairs.join(x.select(F.col("g").alias(f"h{s}"), F.col("block").alias(f"d{s}"), F.col("x").alias(f"x{s}"), F.col("w").alias(f"w{s}")), F.col(f"g{s}").eqNullSafe(F.col(f"h{s}")) & (F.col(f"b{s}") == F.col(f"d{s}")))

    def multiply(batches):
        for batch in batches:
            best = []
            for k in range(batch.num_rows):
                a, c = (np.frombuffer(batch.column(j)[k].as_buffer(), float).reshape(-1, batch.column(3)[k].as_py()) for j in (1, 2))
                best.append(float((a @ c.T).max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64())], ["g", "best"])

    kind = dict(b.dtypes)["g"]
    between = pairs.select(F.col("gl").alias("g"), "xl", "xr", "wl").mapInArrow(multiply, f"g {kind}, best double")
    return b.select("g", "best").unionByName(between).groupBy(F.col("g").alias(group)).agg(F.max("best").alias("best")).where("best IS NOT NULL")


def best_cosine(queries: DataFrame, rows: DataFrame, group: str, query: str, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """query and ``best``, its greatest cosine with a row of its group other than itself; queries without one are absent.

    Both sides are dealt by group and hash into blocks of about ``size``; every
    block of queries is multiplied with every block of rows of its group, as
    matrices, and gives one number for each query.  The products still grow with
    the square of a group, but no pair is written and a task holds two blocks.
    """
    ship(rows.sparkSession)
    width = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    none = F.lit([0.0] * (width[0] if width else 1))  # a missing vector has no cosine, like the zero vector

    def blocked(df: DataFrame, name: str, side: str) -> DataFrame:
        d = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(name).alias("k"), F.coalesce(F.col(vector).cast("array<double>"), none).alias("v"))
        many = d.groupBy("g").agg(F.ceil(F.count("*") / size).alias("parts"))
        d = d.join(many, "g").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
        d = d.groupBy("g", "part").agg(F.collect_list(F.struct("k", "v")).alias("r"))  # about ``size`` rows
        return stored(d.select(F.col("g"), F.col("r.k").alias(f"k{side}"), F.flatten("r.v").alias(f"v{side}")), "blocks")

    pairs = blocked(queries, query, "l").join(blocked(rows, key, "r"), "g")
    pairs = pairs.select("kl", "vl", "kr", "vr")
    pairs = pairs.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 16))  # some 16 pairs of blocks in a task

    def unit(flat, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(flat.values.to_numpy(zero_copy_only=False), float).reshape(n, -1)
        return x, np.sqrt((x * x).sum(1))

    def multiply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(0)[k], batch.column(2)[k]
                (a, na), (b, nb) = (unit(batch.column(j)[k], len(keys)) for j, keys in ((1, left), (3, right)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    c = (a @ b.T) / (na[:, None] * nb[None, :])
                own = left.values.to_numpy(zero_copy_only=False)[:, None] == right.values.to_numpy(zero_copy_only=False)[None, :]
                c[own | ~np.isfinite(c)] = -np.inf
                best, some = c.max(1), ~own.all(1)
                yield pa.RecordBatch.from_arrays([left.values.filter(pa.array(some)), pa.array(np.where(np.isinf(best), np.nan, best)[some], from_pandas=True)], [query, "best"])

    kind = dict(queries.dtypes)[query]
    return pairs.mapInArrow(multiply, f"{query} {kind}, best double").groupBy(query).agg(F.max("best").alias("best"))
