"""Joins that state what a missing or repeated match means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import stored


def asserted(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Inner join in which every left row must find its match; else the query fails, naming the key."""
    r = right.withColumn("_found", F.lit(True))
    d = left.join(r, keys, "left")
    text = F.concat(F.lit(f"{what}: no match for "), F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    return d.where(F.coalesce(F.col("_found"), F.raise_error(text).cast("boolean"))).drop("_found")


def with_default(left: DataFrame, right: DataFrame, keys: list[str], **defaults) -> DataFrame:
    """Left join; named columns of rows without a match, and null ones, take their default."""
    d = left.join(right, keys, "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a result."""
    return work.join(done.select(*keys), keys, "left_anti")


def pairs_within(df: DataFrame, group: list[str], key: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of a group's rows: columns with suffixes _l and _r, the left key smaller.

    The result has as many rows as there are pairs; use it for groups of a
    bounded size, such as the contexts of one image.
    """
    left = df.select(*group, *[F.col(c).alias(c + "_l") for c in [key, *columns]])
    right = df.select(*group, *[F.col(c).alias(c + "_r") for c in [key, *columns]])
    return left.join(right, group).where(F.col(key + "_l") < F.col(key + "_r"))


def bands(h, width: int, parts: list[tuple[int, ...]], n: int) -> Column:
    """Keys by which bit strings meet: for each combination its number and the bits of those of the n bands that it names."""
    each, at = [], 0
    h = F.col(h) if isinstance(h, str) else h
    for k in range(n):
        size = width // n + (k < width % n)
        each.append((at, size))
        at += size

    def key(combination):
        out, shift = F.lit(0).cast("long"), 0
        for k in combination:
            start, size = each[k]
            bits = F.shiftrightunsigned(h, start).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            out, shift = out.bitwiseOR(F.shiftleft(bits, shift)), shift + size
        return out

    return F.array(*[F.struct(F.lit(k).alias("k"), key(c).alias("v")) for k, c in enumerate(parts)])


def hamming_pairs(left: DataFrame, right: DataFrame, id_: str, h: str, most: int = 4, width: int = 64, upper: bool = True) -> DataFrame:
    """id_l, id_r, distance of hashes that differ in at most ``most`` bits.

    Strings that differ in at most ``most`` bits agree in one of most + 1 bands,
    and in two of most + 2.  One band of 64 bits is 12 or 13 bits, which tells
    apart a few thousand hashes; so up to ``2^bits / 4`` distinct ones meet on
    single bands, and more on pairs.  Distinct hashes are compared, each once,
    however many rows have them; a pair that shares several keys is taken at the
    first, which bits of the difference tell.  A task has some 500,000 keys of
    each side.  Joins are merged, as sizes after distinct() and filters are
    guesses.  Only rows whose hash has a partner are joined back.
    """
    same = left is right
    a = left.select(F.col(h).alias("h_l")).distinct()
    b = a.select(F.col("h_l").alias("h_r")) if same else right.select(F.col(h).alias("h_r")).distinct()
    count = a.count()
    few = count <= (1 << width // (most + 1)) // 4
    n, parts = (most + 1, [(k,) for k in range(most + 1)]) if few else (most + 2, [(i, j) for i in range(most + 2) for j in range(i + 1, most + 2)])
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * len(parts) // 500_000)
    met = lambda d, c: d.select(c, F.inline(bands(c, width, parts, n))).repartition(tasks, "k", "v")
    d = met(a, "h_l").join(met(b, "h_r").hint("merge"), ["k", "v"]).withColumn("x", F.col("h_l").bitwiseXOR(F.col("h_r")))
    d = d.withColumn("distance", F.bit_count("x")).where(F.col("distance") <= most)
    first = F.coalesce(*[F.when(key["v"] == 0, k) for k, key in enumerate(bands("x", width, parts, n)[k] for k in range(len(parts)))])
    d = d.where(first == F.col("k")).select("h_l", "h_r", "distance")
    d = d.join(left.select(F.col(id_).alias("id_l"), F.col(h).alias("h_l")).hint("merge"), "h_l").join(right.select(F.col(id_).alias("id_r"), F.col(h).alias("h_r")).hint("merge"), "h_r")
    return (d.where("id_l < id_r") if upper else d).select("id_l", "id_r", "distance")


def first_sibling(rows: DataFrame, siblings: DataFrame, parent: str, order: str, good: Column, key: list[str]) -> DataFrame:
    """Each row, known by ``key``, with its first sibling, by ``order``, for which ``good`` holds (columns of siblings prefixed s_); null if none."""
    s = siblings.select(*[F.col(c).alias("s_" + c) for c in siblings.columns])
    d = rows.join(s, (F.col(parent) == F.col("s_" + parent)) & good, "left")
    rest = [F.first(c).alias(c) for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*s.columns), F.when(F.col("s_" + parent).isNotNull(), F.struct("s_" + order))).alias("_s")
    return d.groupBy(*key).agg(*rest, best).select(*rows.columns, "_s.*")


def budgeted(candidates: DataFrame, budgets: DataFrame, group: list[str], cost: str, budget: str) -> DataFrame:
    """Candidates of a group that cost no more than the group's budget."""
    return candidates.join(budgets.select(*group, budget), group).where(F.col(cost) <= F.col(budget))


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def phrase_hits(docs: DataFrame, doc: str, text: str, phrases: DataFrame, item: str, phrase: str, anchor: int = 5, most: int = 100_000) -> DataFrame:
    """doc, item for every document whose words contain a phrase's words in a row.

    Phrases meet documents by an equi-join on a hash of their first words, at
    most ``anchor``; the words from there on travel with the place and are then
    compared.  Up to ``most`` hashes of anchors are a set by which places are
    sifted before they become rows; beyond that all places become rows.  A
    phrase without a word is in no document.
    """
    from attestor.functions.strings import norm_words

    p = phrases.select(item, norm_words(phrase).alias("_p")).where(F.size("_p") > 0)
    p = p.withColumn("_n", F.least(F.size("_p"), F.lit(anchor))).withColumn("_a", F.xxhash64(F.expr("slice(_p, 1, _n)")))
    longest, sizes = p.agg(F.max(F.size("_p")), F.collect_set("_n")).first()  # at most ``anchor`` numbers
    known = [r[0] for r in p.select("_a").distinct().limit(most + 1).collect()]
    d = docs.select(doc, norm_words(text).alias("_w"))

    def places(n: int) -> Column:
        at = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        every = F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("_w", i + 1, n)).alias("_a")))
        return F.filter(every, lambda x: x["_a"].isin(known)) if len(known) <= most else every

    none = F.array().cast("array<struct<i:int,_a:bigint>>")
    d = d.select(doc, "_w", F.explode(F.concat(*[places(n) for n in sorted(sizes)]) if sizes else none).alias("x"))
    d = d.select(doc, "x._a", F.slice("_w", F.col("x.i") + 1, longest or 1).alias("_w")).join(p, "_a")
    return d.where(F.slice("_w", F.lit(1), F.size("_p")) == F.col("_p")).select(doc, item).distinct()


def gathered(features: DataFrame, row: str, index: DataFrame, at: str, what: str = "a feature row") -> DataFrame:
    """Rows of an index with the feature row that each points to; a row that points nowhere fails the query."""
    f = features.withColumnRenamed(row, at)
    return asserted(index, f, [at], what)


def stacked(parts: dict[str, DataFrame], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): tables one after another, numbered from 0 in ``order`` within each, and part, start, stop of each one's numbers.

    The rows are sorted by range and written once, so that the ranges that are
    counted are the ones that are numbered; no window spans a table.  Rows that
    are equal in ``order`` follow each other in no stated order.
    """
    from functools import reduce

    names = list(parts)
    tagged = reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(k)) for k, d in enumerate(parts.values())])
    keys = [F.col("part"), *[F.col(c) for c in order]]
    n = int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    d = stored(d.withColumn("_bin", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "stacked")
    bins = d.groupBy("_bin").agg(F.count("*").alias("_n"))  # one row for each partition
    bins = bins.select("_bin", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    label = F.element_at(F.lit(names), F.col("part") + 1)
    ranges = d.groupBy("part").agg(F.count("*").alias("n"))
    stop = F.sum("n").over(Window.orderBy("part"))
    ranges = ranges.select(label.alias("part"), (stop - F.col("n")).alias("start"), stop.alias("stop"))
    rows = d.join(bins, "_bin").withColumn("row", F.col("_at") + F.col("_before")).drop("_bin", "_at", "_before")
    return rows.withColumn("part", label), ranges
