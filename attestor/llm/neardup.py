"""Jaccard join of word shingles by chosen paths.

Each text is a set of hashes of ``WIDTH`` consecutive words, embedded as
``COORDS`` minimum hashes.  A run starts with all sets in one bucket.  A bucket
samples coordinates, 1 / THRESHOLD on average, from its own path, and sends each
set to one child per sampled coordinate, named by the set's value there: sets
that share sampled tokens stay together.  Buckets of at most ``SMALL`` sets are
compared by brute force.  What is still larger after ``DEPTH`` splits has a
leader: sets as near to it as candidates are hang on it, and those which, by the
triangle inequality, can be near to no other set leave; the rest is compared in
blocks, but not within the leader's group.  A pair at the threshold survives a split with probability ``survival()``; runs are
repeated until the chance of missing it in all of them is below 1 - ``RECALL``.

Equal sets are one class from the start, so copies cost nothing.  Runs leave a
forest of candidate edges, never all pairs; inside each connected group of
candidates links are then counted exactly on the full sets.  Groups of one
block are compared pair by pair.  In a larger one every set is written as its
differences from a base, the shingles that most of a sample have (any base
gives the right result, a good one gives it soon).  With p / q the threshold, b
the size of the base, and r base shingles missing from a set of s, two sets
without a common difference are linked if and only if their sums of
(p + q) r + p s are at most (p + q) b, so a running count over the sums links
them all at once, and all those links meet in the set with the least sum.
Common differences can only add links: block by block, in order of the sums,
pairs beyond the bound are compared by their differences, and blocks that the
bound decides are passed over.

Defined results: a text of one to four words has one shingle, its words; null
texts, and texts without a word, stand alone; rows with equal ids are told
apart by their texts; the id of a group is its smallest doc_id; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import discard, distinct_words, documents, give_back, lean, ship, slices, written
from attestor.llm.components import components

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDS, SMALL, DEPTH = 64, 256, 4
#: Agreeing coordinates that make a candidate: a pair at the threshold has fewer with probability 4e-4.
CANDIDATE = 40
#: Rows and bytes of a block, rows of one of differences, bytes of small groups aimed at for each task, and columns of a dense piece.
BLOCK, BLOCK_BYTES, EDIT_BLOCK, TASK_BYTES, DENSE = 512, 16 << 20, 256, 1 << 19, 1 << 13
#: Blocks of a large group that meet all its blocks in one part of their join.
SPAN_ROWS = 64
#: Sets of a large group from whose shingles its base is taken.
SAMPLE = 64
#: The threshold as numerator and denominator.
P, Q = Fraction(THRESHOLD).limit_denominator(1000).as_integer_ratio()
_rng = np.random.default_rng(5)
PLACES = (_rng.integers(1 << 62, 1 << 63, WIDTH) | 1).astype(np.uint64)
MIXERS = (_rng.integers(1 << 62, 1 << 63, COORDS) | 1).astype(np.uint64)


def survival(threshold: float = THRESHOLD) -> float:
    """Chance that a pair at the threshold shares a child: one coordinate, or two in a quarter of the buckets."""
    return 0.75 * threshold + 0.25 * (1 - (1 - threshold) ** 2)


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold) ** depth))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_sets(text: pa.Array):
    """For each text the sorted distinct hashes of its shingles; none if it has no word."""
    known, number, n_words = distinct_words(text)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[number]
    h = np.zeros(max(0, len(word) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        h += word[k : k + len(h)] * PLACES[k]
    h = mixed(h)
    stop = 0
    for n in n_words.tolist():
        start, stop = stop, stop + n
        if n >= WIDTH:
            yield np.unique(h[start : stop - WIDTH + 1])
        elif n:
            yield mixed((word[start:stop] * PLACES[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield None


def sketch(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, k : k + 4096] * MIXERS[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, thash (md5 of the text), key (128-bit hash of the shingle set, null if there is none), size, sketch."""
    ship(docs.sparkSession)

    def run(batches):
        for part in chain.from_iterable(map(slices, batches)):
            sets = list(shingle_sets(part.column(1)))
            keys = [None if s is None else xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            sketches = [None if s is None else sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(2), pa.array(keys, pa.binary()), pa.array([0 if s is None else len(s) for s in sets], pa.int32()), pa.array(sketches, pa.list_(pa.int32()))],
                ["doc_id", "thash", "key", "size", "sketch"],
            )

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("thash"))
    return d.mapInArrow(lean(run), "doc_id long, thash string, key binary, size int, sketch array<int>")


class Forest:
    """Edges that connect what all added edges connect, without cycles."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        for x, y in zip(a.tolist(), b.tolist()):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((x, y))


def matrix_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Breadth-first forest of a bipartite matrix of rows and columns: (row, column) edges."""
    rows, cols, out = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool), []
    for r in np.flatnonzero(near.any(1)).tolist():
        if not rows[r]:
            continue
        rows[r], queue = False, [r]
        while queue:
            x = queue.pop()
            for c in np.flatnonzero(near[x] & cols).tolist():
                cols[c] = False
                out.append((x, c))
                for y in np.flatnonzero(near[:, c] & rows).tolist():
                    rows[y] = False
                    out.append((y, c))
                    queue.append(y)
    return out


def split(rows: DataFrame) -> DataFrame:
    """Children of buckets: each path samples one coordinate, or two in a quarter of the cases, from its own hash."""
    second = F.pmod(F.xxhash64("path", F.lit("two")), F.lit(4)) == 0
    first = F.pmod(F.xxhash64("path", F.lit("a")), F.lit(COORDS)).cast("int")
    other = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit("b")), F.lit(COORDS - 1)).cast("int"), F.lit(COORDS))
    picked = F.when(second, F.array(first, other)).otherwise(F.array(first))
    d = rows.select("path", "key", F.col("sketch"), F.explode(picked).alias("c"))
    return d.select(F.xxhash64("path", "c", F.element_at("sketch", F.col("c") + 1)).alias("path"), "key")


def led(big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) from the sets near to their bucket's leader, and the rows (path, key, led, sketch) that must still be compared.

    Sets with the same leader (``led``) are connected.  Sketches of a candidate
    pair differ in at most ``far`` places, a metric, so a led set stays only if
    some other set of the bucket can be that near to it, judged by their
    distances from the leader.
    """
    far = COORDS - CANDIDATE
    first = F.max_by(F.struct(F.col("key").alias("leader"), F.col("sketch").alias("of")), F.xxhash64("path", "key"))
    leaders = written(big.groupBy("path").agg(first.alias("l")).select("path", "l.*"), "leaders")
    apart = F.size(F.filter(F.zip_with("sketch", "of", lambda x, y: x != y), lambda x: x))
    d = written(big.join(leaders, "path").select("path", "key", "sketch", "leader", apart.alias("apart"), (apart <= far).alias("led")), "led")
    nearest = d.where("NOT led").groupBy("path").agg(F.min("apart").alias("nearest"))
    nearest = written(nearest, "nearest")
    rest = d.join(nearest, "path").where(~F.col("led") | (F.col("apart") >= F.col("nearest") - far)).select("path", "key", "led", "sketch")
    return d.where(F.col("led") & (F.col("key") != F.col("leader"))).select(F.col("key").alias("u"), F.col("leader").alias("v")), rest


def candidates(classes: DataFrame, runs: int | None = None) -> DataFrame:
    """u, v: a forest of candidate pairs of classes (key, sketch)."""
    runs = runs_needed() if runs is None else runs
    sketches = classes.select("key", "sketch")
    d = sketches.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    rows = split(d.select(F.xxhash64("run", F.lit("root")).alias("path"), "key", "sketch"))
    small, spent, big = [], [], None
    for level in range(DEPTH):
        # written, so that both sides of the join are plain shuffles and the rows of one path can be split over tasks
        counts = written(rows.groupBy("path").count().where("count > 1"), "counts")
        rows = written(rows.join(counts, "path"), "paths")
        spent += [counts, rows]
        small.append(rows.where(F.col("count") <= SMALL).select("path", "key"))
        big = rows.where(F.col("count") > SMALL).select("path", "key")
        if big.isEmpty():
            big = None
            break
        if level < DEPTH - 1:
            rows = split(big.join(sketches, "key").select("path", "key", "sketch"))
    every = small[0]
    for x in small[1:]:
        every = every.unionByName(x)
    out = brute(every.join(sketches, "key"))
    if big is not None:
        found, rest = led(big.join(sketches, "key"))
        out = out.unionByName(found).unionByName(blocks(rest))
    out = written(out.distinct(), "candidates")
    discard(*spent)
    return out


def brute(rows: DataFrame) -> DataFrame:
    """Candidate pairs within buckets (path, key, sketch) of at most SMALL rows, as a forest for each batch."""

    def pairs(paths, keys, sketches):
        found = Forest(len(keys))
        for d in range(1, SMALL):
            same = np.flatnonzero(paths[d:] == paths[:-d])
            if not len(same):
                break
            for k in range(0, len(same), 5_000):
                at = same[k : k + 5_000]
                good = at[(sketches[at] == sketches[at + d]).sum(1) >= CANDIDATE]
                found.add(good, good + d)
        return pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in found.edges], pa.binary()), pa.array([keys[y] for _, y in found.edges], pa.binary())], ["u", "v"])

    def run(batches):
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            paths = t["path"].to_numpy()
            cut = int(np.searchsorted(paths, paths[-1])) if len(paths) else 0  # the last bucket may go on in the next batch
            left, now = t.slice(cut), t.slice(0, cut).combine_chunks()
            if now.num_rows:
                yield pairs(paths[:cut], now["key"].to_pylist(), now["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, COORDS))
        if left is not None and left.num_rows:
            left = left.combine_chunks()
            yield pairs(left["path"].to_numpy(), left["key"].to_pylist(), left["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, COORDS))

    d = rows.select("path", "key", "sketch").repartition("path").sortWithinPartitions("path")
    return d.mapInArrow(lean(run), "u binary, v binary")


def in_blocks(rows: DataFrame, group: str, outer: str, inner: str | None = None, lots: int = 1 << 20) -> DataFrame:
    """Rows once for each pair of blocks that theirs is in: task, side (1 left, 2 right, 3 both).

    ``outer`` blocks meet all blocks of their group, and ``inner`` ones, for
    rows with a column ``within``, only the outer ones.  Groups of one block
    share ``lots`` tasks.
    """
    n, m = F.col(outer).cast("int"), F.col(inner).cast("int") if inner else F.lit(0)
    within = F.col("within") if inner else F.lit(False)
    hashed = F.xxhash64("key", F.lit("block"))
    own = F.when(within, n + F.pmod(hashed, F.greatest(m, F.lit(1)))).otherwise(F.pmod(hashed, F.greatest(n, F.lit(1)))).cast("int")
    last = F.when(within, n).otherwise(n + m) - 1
    d = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    task = F.when(n + m == 1, F.pmod(F.xxhash64(group), F.lit(lots))).otherwise(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(3)
    return d.withColumns({"task": task, "side": side}).drop("own", "other")


def blocks(rows: DataFrame) -> DataFrame:
    """Candidate pairs within large buckets (path, key, led, sketch), block by block, but for those of sets with one leader."""

    def run(table: pa.Table) -> pa.Table:
        side, keys = table["side"].to_numpy(), table["key"].to_pylist()
        s = table["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        hits = np.zeros((len(left), len(right)), np.int16)
        for c in range(COORDS):
            hits += s[left, c][:, None] == s[right, c][None, :]
        near = (hits >= CANDIDATE) & (left[:, None] != right[None, :])
        edges = [(keys[left[x]], keys[right[y]]) for x, y in matrix_forest(near)]
        return pa.table([pa.array([x for x, _ in edges], pa.binary()), pa.array([y for _, y in edges], pa.binary())], names=["u", "v"])

    per = rows.groupBy("path").agg(F.count_if(~F.col("led")).alias("free"), F.count_if("led").alias("tied"))
    per = written(per.select("path", F.ceil(F.col("free") / BLOCK).alias("outer"), F.ceil(F.col("tied") / BLOCK).alias("inner")), "shares")
    d = rows.join(per, "path").withColumn("within", F.col("led"))
    return in_blocks(d, "path", "outer", "inner").select("task", "side", "key", "sketch").groupBy("task").applyInArrow(run, "u binary, v binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from dense pieces of the incidence matrices."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    li = np.repeat(np.arange(len(left)), [len(x) for x in left])
    ri = np.repeat(np.arange(len(right)), [len(x) for x in right])
    lc, rc = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
    lok, rok = (lc < len(shared)), (rc < len(shared))
    lok[lok] = shared[lc[lok]] == lv[lok]
    rok[rok] = shared[rc[rok]] == rv[rok]
    li, lc, ri, rc = li[lok], lc[lok], ri[rok], rc[rok]
    out = np.zeros((len(left), len(right)))
    lorder, rorder = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    for k in range(0, len(shared), DENSE):
        a, b = np.zeros((len(left), DENSE), np.float32), np.zeros((len(right), DENSE), np.float32)
        p = lorder[slice(*np.searchsorted(lc[lorder], [k, k + DENSE]))]
        q = rorder[slice(*np.searchsorted(rc[rorder], [k, k + DENSE]))]
        a[li[p], lc[p] - k] = 1
        b[ri[q], rc[q] - k] = 1
        out += a @ b.T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    both = overlaps(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    return both >= threshold * union - 1e-9


FOUND = ["key", "n", "other"]


def found_links(keys, left, right, near) -> list[tuple]:
    """(key, links, other) of a matrix of links between rows left and right: counts, and a forest."""
    cross = not np.array_equal(left, right)
    out = [(keys[k], int(c), None) for k, c in zip(left, near.sum(1)) if c]
    out += [(keys[k], int(c), None) for k, c in zip(right, near.sum(0)) if cross and c]
    return out + [(keys[left[x]], 0, keys[right[y]]) for x, y in matrix_forest(near)]


def link_table(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=FOUND)


def member_sets(members: DataFrame) -> DataFrame:
    """component, key, shingles (packed) of each class in a group, from (component, key, text)."""

    def sets(batches):
        before = None
        for part in chain.from_iterable(map(slices, batches)):
            keys, at = part.column(1).to_pylist(), []
            for k, key in enumerate(keys):  # rows of one text follow one another after the join
                if key != before:
                    at.append(k)
                before = key
            part = part.take(pa.array(at, pa.int64()))
            packed = [b"" if s is None else s.tobytes() for s in shingle_sets(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["component", "key", "shingles"])

    return members.select("component", "key", "text").mapInArrow(lean(sets), "component binary, key binary, shingles binary")


def pair_links(sets: DataFrame, lots: int) -> DataFrame:
    """key, n (links found in one task), other (a link that a forest needs, or null) within groups, all pairs of sets compared."""

    def run(table: pa.Table) -> pa.Table:
        keys, side, groups = table["key"].to_pylist(), table["side"].to_numpy(), {}
        packed = table["shingles"].to_pylist()
        for k, g in enumerate(table["component"].to_pylist()):
            groups.setdefault(g, []).append(k)
        out: list[tuple] = []
        for own in groups.values():
            at = np.array(list({keys[k]: k for k in own}.values()))  # a class stands once, whatever rows brought it
            left, right = at[side[at] & 1 > 0], at[side[at] & 2 > 0]
            if not len(left) or not len(right):
                continue
            a, b = ([np.frombuffer(packed[k], np.uint64) for k in x] for x in (left, right))
            out += found_links(keys, left, right, linked(a, b) & (left[:, None] != right[None, :]))
        give_back()
        return link_table(out)

    d = in_blocks(sets, "component", "n_blocks", None, lots).select("task", "side", "component", "key", "shingles")
    return d.groupBy("task").applyInArrow(run, "key binary, n long, other binary")


def bases(sets: DataFrame) -> DataFrame:
    """component, base: the shingles that more than half of a sample of a large group have; SAMPLE sets, more or less, and the first one."""

    def majority(table: pa.Table) -> pa.Table:
        packed = table["shingles"].to_pylist()
        values, times = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in packed]), return_counts=True)
        return pa.table([table["component"][:1], pa.array([values[2 * times > len(packed)].tobytes()], pa.binary())], names=["component", "base"])

    draw = F.pmod(F.xxhash64("key", F.lit("base")), F.lit(1 << 30)) * F.col("n_members") < SAMPLE * (1 << 30)
    some = sets.where(draw | (F.col("key") == F.col("component"))).select("component", "shingles")
    return written(some.groupBy("component").applyInArrow(majority, "component binary, base binary"), "bases")


def differences(sets: DataFrame) -> DataFrame:
    """component, n_blocks, key, c (the sum of the bound), t (the bound), edits (packed): each set against its group's base."""

    def run(batches):
        for batch in batches:
            c, t, edits, known = [], [], [], {}
            for shingles, base in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                have = np.frombuffer(shingles, np.uint64)
                want = known.setdefault(base, np.frombuffer(base, np.uint64))
                gone, more = np.setdiff1d(want, have, True), np.setdiff1d(have, want, True)
                c.append((P + Q) * len(gone) + P * len(have))
                t.append((P + Q) * len(want))
                edits.append(np.concatenate((gone, more)).tobytes())  # a shingle of the base can only be gone, another one only be more
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(c, pa.int64()), pa.array(t, pa.int64()), pa.array(edits, pa.binary())], ["component", "n_blocks", "key", "c", "t", "edits"])

    d = sets.join(bases(sets), "component").select("component", "n_blocks", "key", "shingles", "base")
    return written(d.mapInArrow(lean(run), "component binary, n_blocks long, key binary, c long, t long, edits binary"), "edits")


def bound_links(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (key, n, other) of pairs within the bound, and the sets with their block, in order of c."""
    hist = edits.groupBy("component", "c", "t").agg(F.count("*").alias("n"))
    # counts at c and questions at t - c, in one order: how many sets have a sum of at most t - c
    asked = hist.select("component", (F.col("t") - F.col("c")).alias("x"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "c", "t", F.col("n").alias("same"))
    given = hist.select("component", F.col("c").alias("x"), F.lit(0).alias("kind"), "n", "c", "t", F.col("n").alias("same"))
    w = Window.partitionBy("component").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ordered = given.unionByName(asked).withColumn("upto", F.sum("n").over(w))
    itself = (2 * F.col("c") <= F.col("t")).cast("long")
    answer = F.max(F.when(F.col("kind") == 1, F.col("upto") - itself))
    place = F.max(F.when(F.col("kind") == 0, F.col("upto") - F.col("n")))
    totals = ordered.groupBy("component", "c", "same").agg(answer.alias("links"), place.alias("before"))
    least = edits.groupBy("component").agg(F.min(F.struct("c", "key")).alias("least"), F.count("*").alias("all"))
    totals = written(totals.join(least, "component"), "totals")
    d = edits.join(totals, ["component", "c"])
    hub = (F.col("c") + F.col("least.c") <= F.col("t")) & (F.col("key") != F.col("least.key"))
    links = d.where("links > 0").select("key", F.col("links").alias("n"), F.when(hub, F.col("least.key")).alias("other"))
    at = (F.col("before") + F.pmod(F.xxhash64("key", F.lit("block")), F.col("same"))) * F.col("n_blocks") / F.col("all")
    return links, d.select("component", "key", "c", "t", "edits", F.floor(at).cast("int").alias("block"))


def shared_links(sets: DataFrame) -> DataFrame:
    """Links (key, n, other) of pairs beyond the bound that common differences bring back, from pairs of blocks that can hold any."""
    sets = written(sets, "ordered")
    size = F.octet_length("edits") / 8
    per = written(sets.groupBy("component", "t", "block").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(size).alias("size")), "spans")
    # the blocks of a component meet in parts: each block is on one side in one part, and on the other side in all
    parts = per.groupBy("component").agg(F.ceil(F.count("*") / SPAN_ROWS).alias("parts"))
    per = per.join(parts, "component")
    a, b = (per.select("component", "t", "parts", *[F.col(x).alias(f"{x}_{s}") for x in ("block", "low", "high", "size")]) for s in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("block_a", "t"), F.col("parts"))).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    pairs = a.join(b, ["component", "t", "part"]).where(
        (F.col("block_a") <= F.col("block_b")) & (F.col("high_a") + F.col("high_b") > F.col("t")) & (F.col("low_a") + F.col("low_b") - F.col("t") <= (P + Q) * F.least("size_a", "size_b"))
    )
    both = F.when(F.col("block_a") == F.col("block_b"), F.array(F.struct(F.col("block_a").alias("block"), F.lit(3).alias("side"))))
    both = both.otherwise(F.array(F.struct(F.col("block_a").alias("block"), F.lit(1).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(2).alias("side"))))
    tasks = written(pairs.select("component", "block_a", "block_b", F.inline(both)), "tasks")

    def run(table: pa.Table) -> pa.Table:
        keys, side, c, t = table["key"].to_pylist(), table["side"].to_numpy(), table["c"].to_numpy(), table["t"].to_numpy()
        edits = table["edits"].to_pylist()
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        out: list[tuple] = []
        if len(left) and len(right):
            a, b = ([np.frombuffer(edits[k], np.uint64) for k in x] for x in (left, right))
            beyond = c[left][:, None] + c[right][None, :] - t[0]
            near = (beyond > 0) & ((P + Q) * overlaps(a, b) >= beyond) & (left[:, None] != right[None, :])
            out = found_links(keys, left, right, near)
        give_back()
        return link_table(out)

    d = sets.join(tasks, ["component", "block"]).select("component", "block_a", "block_b", "side", "key", "c", "t", "edits")
    return d.groupBy("component", "block_a", "block_b").applyInArrow(run, "key binary, n long, other binary")


def links(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n_links) and (node, component) over exact links."""
    found = components(candidates(classes))
    member = written(found.withColumnRenamed("node", "key").join(classes.select("key", "rep"), "key").select("component", "key", F.col("rep.thash").alias("thash"), F.col("rep.doc_id").alias("rep_id")), "members")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("thash", F.md5(F.col("text").cast("binary")))
    same = (texts["thash"] == member["thash"]) & texts["doc_id"].eqNullSafe(member["rep_id"])  # copies under other ids stay out
    # always by sorting both sides, so that what moves grows with the input and never jumps from a broadcast to a shuffle
    sets = written(member_sets(texts.join(member.hint("merge"), same)), "sets")
    sizes = sets.groupBy("component").agg(F.count_distinct("key").alias("n_members"), F.sum(F.octet_length("shingles")).alias("bytes"))
    n_blocks = F.greatest(F.ceil(F.col("n_members") / F.when(F.col("n_members") <= BLOCK, BLOCK).otherwise(EDIT_BLOCK)), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("long")
    sizes = written(sizes.withColumn("n_blocks", n_blocks), "sizes")
    total, large = sizes.select(F.sum(F.when(F.col("n_members") <= BLOCK, F.col("bytes"))), F.max("n_members")).first()
    sized = sets.join(sizes, "component")
    out = pair_links(sized.where(F.col("n_members") <= BLOCK), (total or 0) // TASK_BYTES + 1)
    if (large or 0) > BLOCK:
        # by key, and written: else all rows of a group would follow its key into one task
        many = written(sized.where(F.col("n_members") > BLOCK).dropDuplicates(["key"]), "many")
        bound, rest = bound_links(differences(many))
        out = out.unionByName(bound).unionByName(shared_links(rest))
    out = written(out, "links")
    discard(member, sets, sizes)
    n = out.groupBy("key").agg(F.sum("n").alias("n_links"))
    return n, components(out.where("other IS NOT NULL").select(F.col("key").alias("u"), F.col("other").alias("v")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, thash, class_id (smallest doc_id of the group), n_links (other shingle sets at the threshold), n_copies (rows with the same set), keep (the row's text stands for its group)."""
    f = written(features(docs), "features")
    classes = f.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("rep"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    n, groups = links(docs, classes)
    info = classes.select("key", "rep", "n_copies").join(n, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    info = info.withColumn("component", F.coalesce("component", "key"))
    heads = info.groupBy("component").agg(F.min("rep").alias("head"))
    info = info.join(heads, "component").select("key", "head", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")
    d = f.select("doc_id", "thash", "key").join(info, "key", "left")
    return d.select(
        "doc_id",
        "thash",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("key").isNull() | own.eqNullSafe(F.col("head"))).alias("keep"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: one document of each group stays, the one with the smallest id; equal rows are one document."""
    names = docs.columns
    kept = near_duplicates(docs).where("keep").groupBy(F.col("doc_id").alias("kept_id"), F.col("thash").alias("kept_hash")).agg(F.count("*").alias("times"))
    kept = written(kept, "kept")
    rows = docs.select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("thash"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.join(kept, (F.col("thash") == F.col("kept_hash")) & F.col("id").eqNullSafe(F.col("kept_id")))
    out = rows.where("times = 1")
    if not kept.where("times > 1").isEmpty():
        out = out.unionByName(rows.where("times > 1").dropDuplicates(["id", "thash"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")
