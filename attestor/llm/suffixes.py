"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same document or another; strings never cross documents.

1.  Equal texts are collapsed first, so a group of copies is one text with a
    count; if it is long enough, all of it goes.
2.  Each window of LENGTH bytes has an anchor, the ``GRAM`` bytes in it with
    the smallest hash (the leftmost, if several).  Equal windows have equal
    anchors at equal offsets, so only anchors whose gram occurs twice can
    belong to repeated windows.
3.  For those, each task sorts the suffixes that start at its anchors (cut
    where the anchor's last window ends, the bytes to the left kept beside
    them), front-codes them (length shared with the one before, then the rest)
    and sends one run to each range of suffixes.  Suffixes are ordered by the
    spread hash of their gram, then by their bytes, so that ranges are of equal size
    whatever the texts, and need no sample.
4.  Each range merges its runs with a loser tree that keeps, for every loser,
    the prefix it shares with the winner, and so never compares known prefixes
    again.  Neighbours that share the gram form groups; windows are compared
    within the groups, by a hash and then by their bytes.

Groups stay bounded.  An anchor's windows are taken together in bands of
offsets: the windows of a band of ``width`` offsets share LENGTH - width + 1
bytes around the anchor, and the suffix of the band starts where these bytes
do.  One band holds all windows at first (they share the gram); what more than
``LARGE`` anchors share is taken in narrower bands, down to single windows, whose
groups are equal strings.  Each task puts equal strings together before it
sends them: if it holds two, it reports both itself and sends one without
owners, so a passage in a third of all texts is one string of each run.

Defined results: null counts as empty; texts shorter than LENGTH keep all
bytes; copies are told apart by nothing and all go; overlapping windows count;
bytes are judged on the input; a removed run may cut a character, so what is
kept is binary; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import discard, documents, give_back, lean, own_run, partitions, place, ship, slices, written

LENGTH, GRAM = 200, 32
#: Suffixes aimed at for each range; suffixes sorted at a time by a task; least for a range.
RANGE_ROWS, RUN_ROWS, LEAST_ROWS = 20_000, 50_000, 500
#: Anchors beyond which what they share is divided; offsets of a band after the first division and the next ones (each divides the one before).
LARGE, WIDTHS = 20_000, (48, 12, 3, 1)
#: Bytes of a text looked at together; positions within fit the low bits of a key.
CHUNK, LOW_BITS = 1 << 23, 24
_rng = np.random.default_rng(7)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
FACTORS = (_rng.integers(1 << 62, 1 << 63, 24) | 1).astype(np.uint64)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on: blocks of powers of two, by doubling, then joined."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, out, done, width, level = BYTE_VALUES[data], None, 0, 1, 0
    while True:
        if length & width:
            out = block if out is None else out[: len(block) - done] * FACTORS[-1] + block[done:][: len(out)]
            done += width
        if 2 * width > length:
            break
        block = block[:-width] * FACTORS[level] + block[width:]
        width, level = 2 * width, level + 1
    out = out[:n]
    out = (out ^ (out >> np.uint64(29))) * FACTORS[-2]
    return out ^ (out >> np.uint64(32))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    m, done = x, 1
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Position, first and last window, and gram hash of each anchor of a text."""
    parts = []
    windows = len(data) - length + 1
    low = np.uint64((1 << LOW_BITS) - 1)
    for base in range(0, windows, CHUNK):
        piece = data[base : base + CHUNK + length - 1]
        h = rolling(piece, gram)
        x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (window_min(x, length - gram + 1) & low).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(at)])) - 1
        parts.append((at[first] + base, first + base, last + base, h[at[first]].view(np.int64)))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4


def hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each place, a part of the text at a time."""
    out = np.zeros(len(at), np.uint64)
    for base in range(0, len(data), CHUNK):
        here = (at >= base) & (at < base + CHUNK)
        if here.any():
            out[here] = rolling(data[base : base + CHUNK + length - 1], length)[at[here] - base]
    return out.view(np.int64)


def widths(length: int, gram: int) -> list[int]:
    """Offsets of a band, level by level: all that windows of one anchor can have, then fewer."""
    every = length - gram + 1
    return [every, *[w for w in WIDTHS if w < every]]


def bands(at: np.ndarray, first: np.ndarray, last: np.ndarray, width: int):
    """Windows of anchors in bands of ``width`` offsets: number of the anchor, start of the suffix, first and last window."""
    low, high = (at - last) // width, (at - first) // width
    n = high - low + 1
    k = np.repeat(np.arange(len(at)), n)
    start = at[k] - width * (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k])
    return k, start, np.maximum(first[k], start - width + 1), np.minimum(last[k], start)


def entries(text: bytes, level: int, length: int, gram: int, within: np.ndarray | None = None):
    """Start, first and last window, and hash of what is shared, of each band of a level in a text.

    ``within`` has the hashes of bands of the level before, to which it is limited.
    """
    data = np.frombuffer(text, np.uint8)
    at, first, last, h = anchors(data, length, gram)
    start, wide = at, widths(length, gram)
    for k in [level] if within is None else [level - 1, level]:
        if k:
            source, start, first, last = bands(at, first, last, wide[k])
            at = at[source]
            h = hashes(data, start, length - wide[k] + 1) ^ ((at - start) * 0x9E3779B97F4A7C1)
        if k < level:
            keep = np.isin(h, within)
            at, first, last = at[keep], first[keep], last[keep]
    return start, first, last, h


def shared_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that share ``start`` bytes."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (diff.bit_length() + 7) // 8


class LoserTree:
    """Merge of sorted runs of (string, length shared with the one before, payload).

    Each inner node keeps the loser of the match played there and the prefix it
    shares with the winner.  A run's next string shares its front-coded length
    with the string just put out; of two strings that share different lengths
    with that, the one that shares more is smaller, and only equal lengths need
    a look at bytes, from there on.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < max(1, len(self.runs)):
            self.size *= 2
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.size - len(self.runs))
        self.shared = [0] * self.size  # with the last winner that passed, by run
        self.nodes = [0] * self.size
        self.compared = 0
        winners = list(range(self.size))
        level = self.size
        while level > 1:  # the first round: nothing is known, so prefixes start at 0
            level //= 2
            winners = [self._match(level + k, winners[2 * k], winners[2 * k + 1]) for k in range(level)]
        self.top = winners[0]

    def _match(self, node: int, a: int, b: int) -> int:
        """Leave the loser at the node and return the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            winner, loser = (b, a) if x is None else (a, b)
        elif self.shared[a] != self.shared[b]:
            winner, loser = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            start = self.shared[a]
            same = shared_prefix(x[0], y[0], start)
            self.compared += same - start + 1
            winner, loser = (a, b) if x[0][same:] <= y[0][same:] else (b, a)
            self.shared[loser] = same
        self.nodes[node] = loser
        return winner

    def __iter__(self):
        """(string, length shared with the string before, payload) in order."""
        while self.heads[self.top] is not None:
            run = self.top
            string, _, payload = self.heads[run]
            yield string, self.shared[run], payload
            self.heads[run] = head = next(self.runs[run], None)
            self.shared[run] = head[1] if head else 0
            node, winner = (self.size + run) // 2, run
            while node:
                winner = self._match(node, winner, self.nodes[node])
                node //= 2
            self.top = winner


HEAD = struct.Struct("<HHHI")
#: The hash that suffixes are ordered by takes so many bytes before their own.
ORDER_BYTES = 8


def squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(raw, asbytes=True) + struct.pack("<Q", len(raw))


def unsqueezed(blob: bytes) -> bytes:
    (size,) = struct.unpack("<Q", blob[-8:])
    return pa.Codec("zstd").decompress(blob[:-8], decompressed_size=size, asbytes=True)


def front_code(rows: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A sorted run: shared length, length of the rest, length of the left part and of the owner; then their bytes."""
    out, before = [], b""
    for right, left, own in rows:
        same = shared_prefix(before, right, 0)
        rest = right[same:]
        out += [HEAD.pack(same, len(rest), len(left), len(own)), rest, left, own]
        before = right
    return squeezed(b"".join(out))


#: The md5 of a text and the first window of a band in it.
OWNER = struct.Struct("<16sI")
#: The md5 of a text, and the first and last of windows known to be repeated.
KNOWN = struct.Struct("<16sII")


def owner(key: bytes, first: int) -> bytes:
    return OWNER.pack(key, first)


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes of anchors, which are small as the least of many, put evenly over all numbers, different ones apart."""
    x = h.view(np.uint64) * FACTORS[0]
    return (x ^ (x >> np.uint64(32))) * FACTORS[1]


def range_of(start: bytes, ranges: int) -> int:
    """The range of a string by its first four bytes."""
    return int.from_bytes(start[:4], "big") * ranges >> 32


def known_windows(found: list[tuple[bytes, int, int]]) -> bytes:
    """Ranges of windows (md5, first, last), adjoining ones as one."""
    joined: list[list] = []
    for key, a, b in sorted(found):
        if joined and joined[-1][0] == key and a <= joined[-1][2] + 1:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([key, a, b])
    return squeezed(b"".join(KNOWN.pack(*x) for x in joined))


def decode_known(blob: bytes):
    yield from KNOWN.iter_unpack(unsqueezed(blob))


def decode_run(blob: bytes):
    data = unsqueezed(blob)
    at, before = 0, b""
    while at < len(data):
        same, rest, left, own = HEAD.unpack_from(data, at)
        a = at + HEAD.size
        b, at = a + rest + left, a + rest + left + own
        before = before[:same] + data[a : a + rest]
        yield before, same, (data[a + rest : b], data[b:at])


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Whether the ``length`` bytes from each place of a equal those from the place of b.

    A pair of places right after the pair before it has one byte more to compare.
    """
    if not len(a):
        return True
    after = np.concatenate(([False], (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)))
    if not np.array_equal(data[a[after] + length - 1], data[b[after] + length - 1]):
        return False
    a, b, each = a[~after], b[~after], np.arange(length)
    return all(np.array_equal(data[a[k : k + 8192, None] + each], data[b[k : k + 8192, None] + each]) for k in range(0, len(a), 8192))


def earliest(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each window the number of the first one with its bytes."""
    h = rolling(data, length)[at]
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    out = np.empty(len(at), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    again = np.flatnonzero(out != np.arange(len(at)))
    if equal_bytes(data, at[again], at[out[again]], length):
        return out
    seen: dict[bytes, int] = {}  # different windows of one hash: look at all bytes
    return np.array([seen.setdefault(data[p : p + length].tobytes(), k) for k, p in enumerate(at.tolist())], np.int64)


def repeated(members: list[tuple[bytes, bytes, bytes]], length: int):
    """For members (left, right, owner or none) the ranges of repeated windows: (md5, first, last) of each."""
    data = np.frombuffer(b"".join(chain.from_iterable(m[:2] for m in members)), np.uint8)
    sizes = np.fromiter((len(m[0]) + len(m[1]) for m in members), np.int64, len(members))
    windows = sizes - length + 1
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(windows)
    number = np.arange(ends[-1])
    rep = earliest(data, np.repeat(starts - (ends - windows), windows) + number, length)
    twice = rep != number
    twice[rep[twice]] = True
    member = np.repeat(np.arange(len(members)), windows)
    joined = twice[1:] & twice[:-1] & (member[1:] == member[:-1])
    first = np.flatnonzero(twice & ~np.concatenate(([False], joined)))
    last = np.flatnonzero(twice & ~np.concatenate((joined, [False])))
    before = (ends - windows)[member[first]]
    for k, a, b in zip(member[first].tolist(), (first - before).tolist(), (last - before).tolist()):
        if members[k][2]:
            key, s0 = OWNER.unpack(members[k][2])
            yield key, s0 + a, s0 + b


def merged(pairs, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes from ranges of windows."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        b += length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, min(b, size)))
    return out


def distinct_texts(docs: DataFrame) -> DataFrame:
    """thash, text and copies of each distinct text, bucketed by thash so that later joins need not move texts."""
    spark = docs.sparkSession
    name, n = f"texts_{uuid.uuid4().hex}", partitions(docs, 256, most=100_000)  # Spark allows no more buckets
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.md5(text.cast("binary")).alias("thash"), text.alias("text")).groupBy("thash").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    d.write.option("compression", "zstd").option("path", place(spark, name, name)).bucketBy(n, "thash").sortBy("thash").saveAsTable(name)
    return spark.table(name)


def gram_table(texts: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """thash and the distinct hashes (h, times) of what its bands share; from level 1 on, of those within the texts' ``hot`` ones."""

    def run(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            rows = []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                h = entries(text, level, length, gram, batch.column(2)[k].values.to_numpy() if level else None)[3]
                u, n = np.unique(h, return_counts=True)
                rows.append([{"h": x, "n": c} for x, c in zip(u.tolist(), n.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))], ["thash", "grams"])

    return texts.mapInArrow(lean(run), "thash string, grams array<struct<h:long,n:long>>")


def suffix_runs(candidates: DataFrame, ranges: int, level: int, length: int, gram: int) -> DataFrame:
    """range, kind and blob: sorted front-coded runs of the suffixes of the candidates' bands (kind 0), and windows known to be repeated (kind 1)."""

    def run(batches):
        held: dict[tuple[bytes, bytes], list[tuple[bytes, int, int]]] = {}

        def flush():
            places: dict[int, list] = {}
            known: list[tuple[bytes, int, int]] = []
            for (right, left), owners in sorted(held.items()):
                if len(owners) > 1:
                    known += owners
                places.setdefault(range_of(right, ranges), []).append((right, left, owner(*owners[0][:2]) if len(owners) == 1 else b""))
            out = [(k, 0, front_code(rows)) for k, rows in places.items()]
            if known:  # anywhere: nothing is compared with them
                out.append((range_of(min(known)[0], ranges), 1, known_windows(known)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["range", "kind", "blob"])

        n = 0
        for batch in chain.from_iterable(map(slices, batches)):
            for thash, text, grams in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                key = bytes.fromhex(thash)
                start, first, last, h = entries(text, level, length, gram)
                keep = np.isin(h, grams.values.to_numpy())
                order = spread(h[keep]).byteswap().tobytes()
                for k, (a, s0, s1) in enumerate(zip(start[keep].tolist(), first[keep].tolist(), last[keep].tolist())):
                    held.setdefault((order[8 * k : 8 * k + 8] + text[a : s1 + length], text[s0:a]), []).append((key, s0, s1))
                    n += 1
                    if n >= RUN_ROWS:
                        n = 0
                        yield flush()
        if held:
            yield flush()

    return candidates.mapInArrow(lean(run), "range int, kind int, blob binary")


def merge_ranges(runs: DataFrame, shared: int, length: int) -> DataFrame:
    """thash, first, last: ranges of repeated windows, from the merged runs of each range; members of a group share ``shared`` bytes."""

    def merge(table: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]

        def put(key, a, b):
            found[0].append(key.hex())
            found[1].append(a)
            found[2].append(b)

        def settle(members):
            for x in repeated(members, length):
                put(*x)

        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        for kind, blob in zip(kinds, blobs):
            if kind:
                for x in decode_known(blob):
                    put(*x)
        members, group = [], []
        for right, same, (left, own) in LoserTree(decode_run(b) for k, b in zip(kinds, blobs) if not k):
            if same < ORDER_BYTES + shared:
                members += group if len(group) > 1 else []
                if len(members) > RANGE_ROWS:  # windows of different groups differ, so groups can be settled in lots
                    settle(members)
                    members = []
                group = []
            group.append((left, right[ORDER_BYTES :], own))
        members += group if len(group) > 1 else []
        if members:
            settle(members)
        del members, group
        give_back()
        return pa.table([pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["thash", "first", "last"])

    return runs.groupBy("range").applyInArrow(merge, "thash string, first long, last long")


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """thash, first, last: ranges of window starts of ``texts`` whose LENGTH bytes also start elsewhere."""
    wide, out = widths(length, gram), None
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = texts.where(F.octet_length("text") >= length).select("thash", "text")
    for level, width in enumerate(wide):
        table = written(gram_table(todo, level, length, gram), "grams")
        each = table.select("thash", F.explode("grams").alias("g")).select("thash", "g.*")
        divided = F.col("times") > (LARGE if level + 1 < len(wide) else (1 << 63) - 1)
        counts = each.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h", divided.alias("hot"))
        counts = written(counts, "counts")  # so that both sides of the join are plain shuffles and a hash in many texts can be split over tasks
        lists = [F.collect_list(F.when(F.col("hot") == hot, F.col("h"))).alias(name) for name, hot in (("grams", False), ("hot", True))]
        found = written(each.join(counts, "h").groupBy("thash").agg(*lists), "found")
        discard(table, counts)
        size, n_hot = found.select(F.sum(F.size("grams")), F.sum(F.size("hot"))).first()
        # enough ranges for every task, as long as they hold a few hundred suffixes each
        ranges = max(1, (size or 0) // RANGE_ROWS, min((size or 0) // LEAST_ROWS, least))
        some = texts.join(found, "thash")
        runs = suffix_runs(some.where(F.size("grams") > 0).select("thash", "text", "grams"), ranges, level, length, gram)
        merged_ = merge_ranges(runs, length - width + 1, length)
        out = merged_ if out is None else out.unionByName(merged_)
        if not n_hot:
            break
        todo = some.where(F.size("hot") > 0).select("thash", "text", "hot")
    return out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """For each distinct text: thash (md5), copies, n_bytes, spans (maximal removed runs) and kept (the remaining bytes).

    With ``as_text`` what is kept is a string, without characters that were cut in two.
    """
    ship(docs.sparkSession)
    texts = distinct_texts(docs)
    windows = repeated_windows(texts, length, gram).groupBy("thash").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            keys, copies, kept, gone, sizes = batch.column(0), batch.column(2).to_pylist(), [], [], []
            for text, n, rows in zip(batch.column(1).cast(pa.binary()).to_pylist(), copies, batch.column(3).to_pylist()):
                runs = merged([(r["first"], r["last"]) for r in rows or ()], length, len(text))
                if n > 1 and len(text) >= length:
                    runs = [(0, len(text))]
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                left = b"".join([*parts, text[at:]])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                gone.append([{"start": a, "stop": b} for a, b in runs])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([keys, pa.array(copies, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, spans), pa.array(kept, pa.string() if as_text else pa.binary())], ["thash", "copies", "n_bytes", "spans", "kept"])

    joined = texts.join(windows, "thash", "left").select("thash", "text", "copies", "windows")
    return joined.mapInArrow(lean(cut), f"thash string, copies long, n_bytes long, spans array<struct<start:long,stop:long>>, kept {'string' if as_text else 'binary'}")


def text_hash():
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: repeated passages leave the texts; a character cut in two goes with them."""
    names = docs.columns
    kept = dedup(docs, as_text=True).select("thash", "kept")
    put = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    # texts stay where they are: rows move without them and meet what is kept
    rest = F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`") for c in names if c not in put])
    rows = docs.select(text_hash().alias("thash"), rest.alias("rest")).join(kept, "thash")
    return rows.select(*[put[c].alias(c) if c in put else F.col("rest").getField(c).alias(c) for c in names])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    with own_run(spark) as keep:  # the table of texts and all on the way go once the spans are known
        per_text = written(dedup(docs).select("thash", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "spans")
        keep(per_text)
    return docs.select("doc_id", text_hash().alias("thash")).join(per_text, "thash").drop("thash")
