"""Target-distribution importance resampling over hashed n-grams.

Features of a text are all runs of 1 to ``max_n`` consecutive words; a feature's
bucket is the CRC-32 of its UTF-8 bytes, words joined by one space, modulo
``buckets``.  No n-gram is ever written out: the CRC of each distinct word is
computed once, and those of longer runs follow from it.  CRC-32 is linear over
GF(2), so crc(a || b) = Z^len(b) crc(a) xor crc(b), where Z is the 32 x 32 bit
matrix that shifts a CRC past one zero byte; powers of Z are found by squaring
and applied a byte at a time.

Two passes read all texts: the first adds up the buckets of documents and of
the target, in each task before anything is shuffled, the second adds up each
document's gains.  What reaches the driver is one number for each bucket.  Ranks
come from a table sorted by range, whose partitions are counted once.

Defined results: null and empty texts have no features and weight 0; a null id
counts as empty in its hash and stays null; texts of any length are whole; ties
go to the smaller id (null first), equal rows get different ranks; with no
target text every feature counts against its bucket's share of documents; an
empty table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import discard, distinct_words, documents, gathered, lean, partitions, ship, slices, written

MAX_N, BUCKETS, SEED, PERCENT, LEAST = 1, 10_000, "2024", 10, 20
#: Lower-cases A-Z and turns what stands in no word into a space; bytes from 128 belong to words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A bit matrix, given by the images of the 32 bits, times each of ``x``."""
    out = np.zeros(x.shape, np.uint32)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def squared(power: int) -> np.ndarray:
    """Z to the power of 2^power."""
    if power:
        half = squared(power - 1)
        return times(half, half)
    # A CRC of unit vectors past one zero byte; crc32 conditions both ends, which cancels between two messages.
    zero = zlib.crc32(b"\0", 0)
    return np.array([zlib.crc32(b"\0", 1 << bit) ^ zero for bit in range(32)], np.uint32)


@lru_cache(maxsize=4096)
def shift(length: int) -> np.ndarray:
    """Z to the power of ``length`` as four tables, one for each byte of a CRC."""
    matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(length.bit_length()):
        if length >> power & 1:
            matrix = times(squared(power), matrix)
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([times(matrix, byte << np.uint32(8 * k)) for k in range(4)])


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC past so many zero bytes."""
    known, which = np.unique(length, return_inverse=True)
    tables = np.stack([shift(int(n)) for n in known]) if len(known) else np.zeros((1, 4, 256), np.uint32)
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= tables[which, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_texts(text: pa.Array) -> pa.Array:
    """Texts of lower-case words with spaces around them; null counts as empty."""
    whole = pa.array([b"" if x is None else x.translate(_WORD) for x in text.cast(pa.binary()).to_pylist()], pa.binary())
    return whole.cast(pa.string())


def feature_crcs(text: pa.Array, max_n: int):
    """For each order the CRC of each run of words, and the number of runs of each text; then the words of each text."""
    known, number, sizes = distinct_words(word_texts(text))
    crc = np.array([zlib.crc32(w) for w in known], np.uint32)
    long = np.array([len(w) for w in known], np.int64)
    spaced = shifted(np.full(len(known), zlib.crc32(b" "), np.uint32), long) ^ crc  # of a space and the word
    out, run, count = [(crc[number], sizes)], crc[number], sizes
    stops = np.cumsum(sizes)
    for n in range(2, max_n + 1):
        fewer = np.maximum(sizes - n + 1, 0)
        every = np.arange(len(sizes))
        first, _ = gathered(np.arange(len(run)), np.cumsum(count) - count, fewer, every)  # runs one word shorter that do not end their text
        last, _ = gathered(number, stops - sizes + n - 1, fewer, every)
        run, count = shifted(run[first], long[last] + 1) ^ spaced[last], fewer
        out.append((run, count))
    return out, sizes


def bucket_counts(docs: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for part in slices(whole):
                for crc, _ in feature_crcs(part.column(0), max_n)[0]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    s_all, t_all, buckets = int(docs.sum()), int(target.sum()), len(docs)
    ratio = [((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(docs.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """doc_id, n_words, n_features, and the sum of the features' gains."""

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                features, words = feature_crcs(part.column(1), max_n)
                total, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for crc, count in features:
                    ends = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(len(gain))])))
                    stops = np.cumsum(count)
                    total += ends[stops] - ends[stops - count]
                    n += count
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(words, pa.int64()), pa.array(n), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str):
    """Thousandths of a Gumbel variate from a hash of the id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """Every document's weight and score; ``percent`` of those with ``least`` words are drawn and ranked, the others have no rank."""
    spark = docs.sparkSession
    ship(spark)
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    scored = written(weighted(docs, gain, max_n).withColumn("score", F.col("weight") + noise(seed)), "weights")
    fits = F.col("n_words") >= least
    order = [(~fits).asc(), F.when(fits, -F.col("score")).asc(), F.col("doc_id").asc(), F.col("row").asc()]  # the row number splits equal rows
    by_range = scored.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(scored), *order).sortWithinPartitions(*order)
    place = by_range.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = written(place, "ranked")
    discard(scored)
    before, start = {}, 0
    for r in sorted(placed.where(fits).groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        before[r.part], start = start, start + r.n
    starts = spark.createDataFrame(list(before.items()), "part int, start long")  # one row for each partition
    rank = F.when(fits, F.col("start") + F.col("row") + 1)
    return placed.join(F.broadcast(starts), "part", "left").select("doc_id", "n_features", "weight", "score", F.when(rank <= start * percent // 100, rank).alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 as a fold over the bits of each distinct word.
OP13_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
long AS (SELECT doc_id, unnest(w) AS w FROM doc_words),
words AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM long UNION ALL SELECT w FROM target_words)),
bits AS (
  SELECT w, list_transform(range(4 * length(x)), lambda i: ((strpos('0123456789ABCDEF', substr(x, 2 * (i // 8) + (CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END), 1)) - 1) >> (i % 4)::INT) & 1) AS b FROM words),
crc AS (
  SELECT w, xor(list_reduce(list_transform(b, lambda y: y::BIGINT), lambda c, y: xor(c >> 1, (xor(c, y) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bits),
s AS (SELECT bucket, count(*) AS s FROM long JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN crc USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM long) AS s_all, (SELECT count(*) FROM target_words) AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket) CROSS JOIN totals),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM long JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc_words d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
