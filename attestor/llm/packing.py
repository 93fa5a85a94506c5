"""Packing into length buckets that a dynamic programme chooses.

Documents are cut into pieces of at most ``max_len`` tokens (all of a text is
kept, in order).  The histogram of piece lengths over all documents, at most
``max_len`` + 1 numbers, goes to the driver, where a dynamic programme finds
the ``buckets`` boundaries with the least padding.  Inside each bucket, pieces
form batches of as many rows as fit the token budget.

Places within a bucket are found without a window over the bucket: pieces are
spread over salts by a hash, salts are counted, and a piece's place is its
salt's offset plus its rank in the salt.

Defined results: null and empty texts make one piece of 0 tokens in the first
bucket; rows with equal ids are told apart by their place alone; an empty
table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import documents, let, words, written

MAX_LEN, BUCKETS, BUDGET = 4096, 12, 65_536
#: Pieces aimed at for each salt, and most salts: beyond 3e7 pieces a salt grows with the table, to some 2e4 pieces at 1e9.
SALT_ROWS, MOST_SALTS = 512, 1 << 16


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper bounds of at most ``buckets`` buckets that minimise the padding of these lengths."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    n = len(x)
    if n == 0:
        return []
    before = np.concatenate(([0], np.cumsum(c)))
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)  # tokens of the first j lengths, padding included
    cost[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, arg = cost.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            options = cost[:j] + (before[j] - before[:j]) * x[j - 1]
            arg[j] = options.argmin()
            new[j] = options[arg[j]]
        back.append(arg)
        cost = new
    found, j = [], n
    for arg in reversed(back):
        found.append(int(x[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    return found[::-1]


def word_parts(text: Column, max_len: int) -> Column:
    """A text in parts of ``max_len`` words with the white space before them; the last part takes the rest.

    Words are told from white space one at a time, so that a text of any length is cut without deep matching.
    """
    each = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    end = F.regexp_extract(text, r"[\x20\x09-\x0D]*\z", 0)

    def cut(w: Column) -> Column:
        last = F.ceil(F.size(w) / max_len).cast("int") - 1
        part = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * max_len + 1, F.lit(max_len)), ""))
        return F.transform(part, lambda p, i: F.when(i == last, F.concat(p, end)).otherwise(p))

    return let(each, cut)


def pieces(docs: DataFrame, length: Column, max_len: int, with_text: bool = False) -> DataFrame:
    """doc_id, row (a hash of the text, to tell rows of one id apart), piece, first_token, n_tokens, and the piece's text if asked for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # lengths first, so that they are not found once more for the pieces
    d = docs.select("doc_id", length.cast("long").alias("n"), F.xxhash64("text").alias("row"), *([text.alias("text")] if with_text else []))
    last = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)) - 1
    each = F.sequence(F.lit(0).cast("long"), last)
    if with_text:
        parts = F.when(last == 0, F.array("text")).otherwise(word_parts(F.col("text"), max_len))
        d = d.select("doc_id", "n", "row", F.posexplode(parts).alias("piece", "text")).withColumn("piece", F.col("piece").cast("long"))
    else:
        d = d.select("doc_id", "n", "row", F.explode(each).alias("piece"))
    first = F.col("piece") * max_len
    kept = ["doc_id", "row", "piece", first.alias("first_token"), F.least(F.col("n") - first, F.lit(max_len)).cast("long").alias("n_tokens")]
    return d.select(*kept, *(["text"] if with_text else []))


def pack(docs: DataFrame, length: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, with_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot, and its text if asked for.

    ``length`` is the number of tokens of a row; its words if not given.
    """
    length = F.size(words(F.col("text"))) if length is None else length
    p = written(pieces(docs, length, max_len, with_text), "pieces")
    rows = p.groupBy("n_tokens").count().toArrow()  # at most max_len + 1 rows
    sizes, counts = rows["n_tokens"].to_numpy(), rows["count"].to_numpy()
    bounds = boundaries(sizes, counts, buckets) or [0]
    salts = int(min(MOST_SALTS, counts.sum() // SALT_ROWS + 1))
    bucket = F.size(F.filter(F.lit(bounds), lambda b: b < F.col("n_tokens")))
    p = p.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "row"), F.lit(salts)))
    per = p.groupBy("bucket", "salt").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("bucket", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "piece", "row"))
    p = p.withColumn("rank", rank).join(per, ["bucket", "salt"])
    place = F.col("offset") + F.col("rank") - 1
    upper = F.lit(bounds)[F.col("bucket")].cast("long")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest(upper, F.lit(1))), F.lit(1)).cast("long")
    return p.select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "bucket",
        upper.alias("bucket_len"),
        F.floor(place / per_batch).alias("batch"),
        (place % per_batch).alias("slot"),
        *(["text"] if with_text else []),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: the pieces of the documents, with their texts, in batches."""
    return pack(docs, with_text=True)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
