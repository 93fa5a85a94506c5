"""Document fingerprints from closed syncmers, with built-in expressions only.

A window of ``k`` words is an anchor (a closed syncmer) if the smallest hash
among its inner runs of ``s`` words lies at its first or last place.  Whether a
window is an anchor depends on nothing outside it, so a passage has the same
anchors wherever it stands, and of ``k - s`` windows in a row at least one is an
anchor.  The fingerprint holds all anchors with their positions.  Two texts are
matched by position: anchors of equal hash are paired one to one in order of
position; pairs of equal shift at most ``k`` words apart make up a passage, words
that both texts have.  The likeness is the share of anchors in passages that
follow each other in both texts: reading the pairs of all passages in the order
of the first text, those count that lie beyond all before them in the second
(or, read backwards, before all after them, whichever are more).  So a text
whose passages were moved about is less like than one that was cut or edited.

Defined results: null text counts as empty; an empty fingerprint is '' and is
like another empty one to 1.0 and like any other to 0.0; a text of fewer than
``k`` words has one anchor, its words; texts of equal words have equal fingerprints;
rows with equal ids are ordered by a hash of their texts, null ids come last;
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import discard, documents, let, words, written

K, S = 5, 2
#: Hashes keep 40 bits, ten hexadecimal digits in the fingerprint; one more tells the words since the anchor before, at most K - S.
MASK = (1 << 40) - 1
#: Rows aimed at for each bucket in which neighbours are looked for, and most buckets: beyond 6.5e8 rows a bucket grows with the table.
BUCKET_ROWS, MOST_BUCKETS = 10_000, 1 << 16


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos:int, hash:bigint>> of a text's closed syncmers, in order of position."""
    inner = k - s + 1

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))

        def pick(h: Column) -> Column:
            def at(i: Column) -> Column:
                row = [F.get(h, i + j) for j in range(inner)]
                low = F.least(*row)
                whole = F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(MASK)
                return F.when((low == row[0]) | (low == row[-1]), F.struct(i.alias("pos"), whole.alias("hash")))

            return F.filter(F.transform(F.sequence(F.lit(0), n - k), at), lambda x: x.isNotNull())

        short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(w).bitwiseAND(MASK).alias("hash")))
        return F.when(n == 0, F.slice(short, 1, 0)).when(n < k, short).otherwise(let(runs, pick))

    return let(words(text), of)


def as_text(a: Column) -> Column:
    """All anchors in order: the hash, and the distance from the anchor before it (at the first, its position)."""
    def one(x: Column, i: Column) -> Column:
        gap = x["pos"] - F.when(i == 0, 0).otherwise(F.get(a, i - 1)["pos"])
        return F.concat(F.lpad(F.hex(x["hash"]), 10, "0"), F.hex(gap))

    return F.array_join(F.transform(a, one), "")


def runs_of(c: Column, breaks, body) -> Column:
    """array of body(run) over the runs of an array; breaks(x, before) tells where the next one starts."""
    def of(c: Column) -> Column:
        first = F.filter(F.transform(c, lambda x, i: F.when((i == 0) | breaks(x, F.get(c, i - 1)), i)), lambda i: i.isNotNull())

        def cut(s: Column) -> Column:
            return F.transform(s, lambda i, j: let(F.slice(c, i + 1, F.coalesce(F.get(s, j + 1), F.size(c)) - i), body))

        return let(first, cut)

    return let(c, of)


def matches(a: Column, b: Column) -> Column:
    """array<struct<at:int, shift:int>>: anchors of both texts paired one to one, by hash and then in order of position.

    ``at`` is the place in the first text and ``at + shift`` that in the second.
    """
    def side(x: Column, n: int) -> Column:
        return F.transform(x, lambda y: F.struct(y["hash"].alias("hash"), F.lit(n).alias("side"), y["pos"].alias("pos")))

    def pair(run: Column) -> Column:
        left, right = F.filter(run, lambda x: x["side"] == 0), F.filter(run, lambda x: x["side"] == 1)
        both = F.zip_with(left, right, lambda x, y: F.struct(x["pos"].alias("at"), (y["pos"] - x["pos"]).alias("shift")))
        return F.filter(both, lambda x: x["shift"].isNotNull())

    hashes = [F.transform(x, lambda y: y["hash"]) for x in (a, b)]
    found = F.flatten(runs_of(F.sort_array(F.concat(side(a, 0), side(b, 1))), lambda x, before: x["hash"] != before["hash"], pair))
    return F.when(F.arrays_overlap(*hashes), found).otherwise(F.array().cast("array<struct<at:int,shift:int>>"))


def passages(pairs: Column, k: int = K) -> Column:
    """array<array<struct<shift:int, at:int>>>: pairs of one shift, each at most ``k`` words from the one before."""
    order = F.sort_array(F.transform(pairs, lambda x: F.struct(x["shift"].alias("shift"), x["at"].alias("at"))))
    return runs_of(order, lambda x, before: (x["shift"] != before["shift"]) | (x["at"] - before["at"] > k), lambda r: r)


def rising(found: Column) -> Column:
    """How many numbers exceed all before them."""
    start = F.struct(F.lit(-(1 << 31) + 1).alias("top"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["top"], x).alias("top"), (s["n"] + (x > s["top"]).cast("int")).alias("n"))
    return F.aggregate(found, start, step, lambda s: s["n"])


def in_order(a: Column, b: Column, found: Column) -> Column:
    """Pairs that follow each other in both texts, of passages of two pairs or more; a single pair counts where a text has no other anchor."""
    alone = (F.size(a) == 1) | (F.size(b) == 1)
    pairs = F.flatten(F.filter(found, lambda r: alone | (F.size(r) > 1)))
    there = F.transform(F.sort_array(F.transform(pairs, lambda x: F.struct(x["at"].alias("at"), x["shift"].alias("shift")))), lambda x: x["at"] + x["shift"])
    return let(there, lambda t: F.greatest(rising(t), rising(F.transform(F.reverse(t), lambda x: -x))))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Anchors paired in order over all anchors of both texts, a pair counted once."""
    return let(in_order(a, b, found), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double"))


def passage(found: Column, text: Column, k: int = K) -> Column:
    """Words of the longest passage: a stretch of the first text that pairs of one shift cover without a gap."""
    spans = F.transform(found, lambda r: F.element_at(r, -1)["at"] - r[0]["at"])
    # only a text of one anchor can be shorter than k
    width = F.when((F.size(found) == 1) & (F.array_max(spans) == 0), F.least(F.size(words(text)), F.lit(k))).otherwise(k)
    return F.when(F.size(found) == 0, 0).otherwise(F.array_max(spans) + width).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A string that sorts rows by descending id, null ids last, and rows of one id by a hash of their texts."""
    def digits(x: Column) -> Column:
        return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")

    at = F.coalesce(F.concat(F.lit("0"), digits(F.bitwise_not(doc_id.cast("long")))), F.lit("1"))
    return F.concat(at, digits(F.xxhash64(text)))


def heads(docs: DataFrame) -> list[str]:
    """The first place of each bucket, in order: of ranges of about BUCKET_ROWS rows, at most MOST_BUCKETS strings."""
    spark = docs.sparkSession
    places = written(docs.select(place(F.col("doc_id"), F.col("text")).alias("place")), "places")
    n = places.count()
    count = max(n // BUCKET_ROWS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = places.repartitionByRange(max(1, min(count, n, MOST_BUCKETS)), "place").groupBy(F.spark_partition_id().alias("bucket")).agg(F.min("place").alias("place"))
    found = sorted(r.place for r in d.select("place").collect())
    discard(places)
    return found


def bucket_of(at: Column, first: list[str]) -> Column:
    """Number of the bucket of a place: a search in two steps, some hundred comparisons at most."""
    side = max(1, round(len(first) ** 0.5))
    coarse = F.lit(first[::side])
    fine = F.array(*[F.lit(first[i : i + side]) for i in range(0, len(first), side)])
    high = F.size(F.filter(coarse, lambda x: x <= at)) - 1
    return let(high, lambda h: h * side + F.size(F.filter(F.get(fine, h), lambda x: x <= at)) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of (doc_id, text) with the next row's text by descending doc_id; after the last comes the first.

    Rows are windowed within buckets of neighbours.  The first row of a bucket
    also stands, as a sentinel, at the end of the bucket before, so that no
    window spans the table.  Documents are read twice: for the places of the
    buckets, and for this.
    """
    first = heads(docs)
    if not first:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    d = docs.select("doc_id", "text", place(F.col("doc_id"), F.col("text")).alias("place"))
    d = d.withColumn("bucket", bucket_of(F.col("place"), first))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("sentinel"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(first))).alias("bucket"), F.lit(True).alias("sentinel"))
    is_head = F.col("place") == F.get(F.lit(first), F.col("bucket"))
    d = d.select("doc_id", "text", "place", F.inline(F.when(is_head, F.array(here, before)).otherwise(F.array(here))))
    # rows that repeat a head altogether are sentinels too, which does no harm: the nearest one is taken
    w = Window.partitionBy("bucket").orderBy("sentinel", "place")
    d = d.withColumn("next_text", F.lead("text").over(w))
    return d.where("NOT sentinel").select("doc_id", "text", "next_text")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text; null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp (array of anchors)."""
    return texts(docs).withColumn("fp", anchors(F.col("text")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(texts(documents(spark, sf_dir)))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.select("doc_id", "text", n.cast("long").alias("n_chars"), "next_text", edited.alias("edited"))
    # anchors are made here, not before the rows move: texts are smaller than their anchors
    d = d.withColumns({"fp": anchors(F.col("text")), "next_fp": anchors(F.col("next_text")), "edited_fp": anchors(F.col("edited"))})
    d = d.withColumns({"with_edited": passages(matches(F.col("fp"), F.col("edited_fp"))), "with_next": passages(matches(F.col("fp"), F.col("next_fp")))})
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), F.col("with_edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), F.col("with_next")).alias("near_next"),
        passage(F.col("with_edited"), F.col("text")).alias("edited_passage"),
        passage(F.col("with_next"), F.col("text")).alias("next_passage"),
    )
