"""Images: size, failed decoding and difference hash of each file.

Files are decoded in the JVM by Spark's image source.  Grey levels are averaged
over a grid of 9 x 8 fields by area, in Arrow batches; the comparison bits and
their packing are an expression over the 72 levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.numeric import col
from attestor.session import ship

#: Fields of a difference hash, and the weights of red, green and blue in 65,536ths.
ACROSS, DOWN, LUMA = 9, 8, (19595, 38470, 7471)


def shares(size: int, fields: int) -> np.ndarray:
    """[fields, size]: the length that each pixel and each field have in common, in parts of a pixel of which there are ``fields``."""
    field, pixel = np.arange(fields)[:, None] * size, np.arange(size) * fields
    return np.clip(np.minimum(field + size, pixel + fields) - np.maximum(field, pixel), 0, None)


def grey_levels(data: bytes, width: int, height: int, channels: int) -> list[int]:
    """Mean grey levels of the fields, row by row, from bytes in the order blue, green, red (or one grey)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels == 1:
        grey = x[..., 0]
    else:
        grey = (x[..., 2] * LUMA[0] + x[..., 1] * LUMA[1] + x[..., 0] * LUMA[2] + 0x8000) >> 16
    area = height * width
    return ((2 * (shares(height, DOWN) @ grey @ shares(width, ACROSS).T) + area) // (2 * area)).ravel().tolist()  # whole numbers, so halves round up everywhere


def difference_hash(levels, across: int = ACROSS, down: int = DOWN) -> Column:
    """Hex digits of the comparisons of each level with the one to its right, the first comparison in the highest bit."""
    v = col(levels)
    bits = [F.when(v[y * across + x] > v[y * across + x + 1], 1).otherwise(0) for y in range(down) for x in range(across - 1)]
    digits = []
    for k in range(0, len(bits), 4):
        value = bits[k] * 8 + bits[k + 1] * 4 + bits[k + 2] * 2 + bits[k + 3]
        digits.append(F.lower(F.hex(value)))
    return F.concat(*digits)


def images(spark: SparkSession, path: str) -> DataFrame:
    """file, ok, width, height, levels and dhash of each image; what cannot be decoded is not ok and has no figures.

    A file without a byte gives no row, so size_problems finds it missing.
    """
    ship(spark)
    d = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches):
        for b in batches:
            rows = []
            for data, w, h, c in zip(*(b.column(k).to_pylist() for k in ("data", "width", "height", "nChannels"))):
                rows.append(grey_levels(data, w, h, c) if w > 0 and h > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("width"), b.column("height"), pa.array(rows, pa.list_(pa.int32()))], ["file", "width", "height", "levels"])

    found = d.mapInArrow(run, "file string, width int, height int, levels array<int>")
    ok = F.col("levels").isNotNull()
    size = [F.when(ok, F.col(c)).alias(c) for c in ("width", "height")]
    return found.select("file", ok.alias("ok"), *size, "levels", F.when(ok, difference_hash("levels")).alias("dhash"))


def size_problems(found: DataFrame, stated: DataFrame, key: str = "file") -> DataFrame:
    """key and problem of images whose size differs from the stated width and height: missing, undecodable, swapped or other."""
    s = stated.select(F.col(key).alias("_k"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    d = s.join(found, F.col(key) == F.col("_k"), "left")
    problem = F.when(F.col(key).isNull(), "missing").when(~F.col("ok"), "undecodable").when((F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")), None)
    problem = problem.when((F.col("width") == F.col("_h")) & (F.col("height") == F.col("_w")), "swapped").otherwise("other")
    return d.select(F.col("_k").alias(key), problem.alias("problem")).where("problem IS NOT NULL")
