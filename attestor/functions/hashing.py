"""Ids, cache keys, fingerprints and splits from SHA-256."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.numeric import col

UNIT = "\x1f"


def opaque(prefix: str, *parts, digits: int = 16) -> Column:
    """prefix_ and the first digits of the hash of the parts joined by a unit separator."""
    text = F.concat_ws(UNIT, *[col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, digits))


def opaque_json(prefix: str, *parts, digits: int = 16) -> Column:
    """The same over the JSON array of the parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(F.array(*[col(p).cast("string") for p in parts])), 256), 1, digits))


def canonical_json(**fields) -> Column:
    """Compact JSON with keys in sorted order; null fields are kept."""
    return F.to_json(F.struct(*[col(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def cache_key(**fields) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def row_id(fields: list[str], digits: int = 24) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, digits)


def mod10(text) -> Column:
    """The whole 256-bit hash modulo 10: 16 to any power is 6 modulo 10."""
    h = F.sha2(col(text), 256)
    nibbles = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    return ((F.aggregate(nibbles, F.lit(0), lambda a, x: a + x) * 6 + F.conv(F.substring(h, 64, 1), 16, 10).cast("int")) % 10).cast("int")


def split_60_20_20(key, salt: str, names: tuple[str, str, str] = ("train", "dev", "test")) -> Column:
    b = mod10(F.concat(F.lit(salt + ":"), col(key).cast("string")))
    return F.when(b < 6, names[0]).when(b < 8, names[1]).otherwise(names[2])


def hash_order(seed, *parts) -> Column:
    """Sort key for a reproducible shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts]), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row, the fingerprint of a table whatever the order of its rows.

    Row hashes are added up modulo 2**61 - 1 in eight 32-bit lanes, so any
    number of rows takes bounded memory, then hashed with the row count.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"l{k}") for k in range(8)]
    d = df.agg(F.count("*").alias("n"), *lanes)
    return d.select(F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in d.columns]), 256).alias("fingerprint"))


def run_fingerprint(**settings) -> str:
    """Hash of a run's settings, on the driver."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def hex64(c) -> Column:
    """16 hexadecimal digits as a signed 64-bit number."""
    high, low = (F.conv(F.substring(col(c), k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))
