"""Token ids kept as one wavelet matrix per shard.

A shard is one file: the ids of consecutive documents, with a mark at the end
of each, and the numbers of the documents.  Its distinct ids are numbered
densely; bit plane j holds bit j (from the top) of each number, in the order
that stable partition by the planes above leaves.  Each plane has a count of
ones per 512 bits, so access, counting, select and the list of occurrences read
a block of 64 bytes of each plane for each answer.  The planes are plain bits,
as rank and select need them; the shared folder keeps files in Parquet pages
compressed with zstd.

File: ``WVS2``, u64 bytes of the matrix, the matrix, u64 documents, i64[] their
numbers, u8[] whether there is one.  Matrix: ``WVM2``, u64 length, u32 levels,
u32 alphabet size, u32[] alphabet, and per level u64 number of zeros, u32[] ones
before each block of 512 bits, and the bits (lowest first), in whole blocks.
All numbers are little-endian.  The mark is one more than the largest id, so
that it cannot be taken for an end id that stands in a text; it is read back as
the end id.

Defined results: null text counts as empty, so its document holds the end id
alone; rows with equal ids follow one another, ordered by text; null ids come
first; an empty table makes no shard; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import documents, lean, partitions, ship, slices, written
from attestor.llm.memo import WordMemo, packed_ids

BLOCK, WORDS = 512, 8
ALL_ONES = np.uint64((1 << 64) - 1)
END_ID = 1
#: Ids at which a shard is closed; a document is never split.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """Succinct sequence of integers with access, rank, select and full decoding."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.alphabet, self.planes = n, alphabet, planes

    @staticmethod
    def build(values: np.ndarray) -> WaveletMatrix:
        values = np.asarray(values)
        n = len(values)
        if n == 0:
            return WaveletMatrix(0, np.zeros(0, np.uint32), [])
        seen = np.zeros(int(values.max()) + 1, bool)
        seen[values] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        levels = max(1, int(len(alphabet) - 1).bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        number = np.zeros(len(seen), kind)
        number[alphabet] = np.arange(len(alphabet), dtype=kind)
        x = number[values]
        planes = []
        for j in range(levels - 1, -1, -1):
            bit = (x & kind(1 << j)).astype(bool)
            packed = np.zeros(-(-n // BLOCK) * WORDS, "<u8")
            packed.view(np.uint8)[: -(-n // 8)] = np.packbits(bit, bitorder="little")
            packed = packed.reshape(-1, WORDS)
            planes.append((n - int(np.count_nonzero(bit)), _ranks(packed), packed))
            if j:
                x = np.concatenate((x.take(np.flatnonzero(~bit)), x.take(np.flatnonzero(bit))))  # without a branch for each bit, as a mask has
        return WaveletMatrix(n, alphabet, planes)

    def to_bytes(self) -> bytes:
        parts = [b"WVM2", struct.pack("<QII", self.n, len(self.planes), len(self.alphabet)), self.alphabet.astype("<u4").tobytes()]
        for zeros, ranks, packed in self.planes:
            parts += [struct.pack("<Q", zeros), ranks.astype("<u4").tobytes(), packed.tobytes()]
        return b"".join(parts)

    @staticmethod
    def from_bytes(blob: bytes) -> WaveletMatrix:
        if bytes(blob[:4]) != b"WVM2":
            raise ValueError("not a wavelet matrix")
        n, levels, size = struct.unpack_from("<QII", blob, 4)
        at = 20
        alphabet = np.frombuffer(blob, "<u4", size, at)
        at += 4 * size
        blocks, planes = -(-n // BLOCK), []
        for _ in range(levels):
            (zeros,) = struct.unpack_from("<Q", blob, at)
            ranks = np.frombuffer(blob, "<u4", blocks, at + 8)
            packed = np.frombuffer(blob, "<u8", blocks * WORDS, at + 8 + 4 * blocks).reshape(-1, WORDS)
            planes.append((zeros, ranks, packed))
            at += 8 + 4 * blocks + 8 * WORDS * blocks
        return WaveletMatrix(n, alphabet, planes)

    def _ones(self, plane, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits, for each i."""
        _, ranks, packed = plane
        block = np.minimum(i // BLOCK, len(ranks) - 1)
        take = np.clip((i - block * BLOCK)[:, None] - 64 * np.arange(WORDS), 0, 64)  # bits of each word that count
        mask = np.where(take == 64, ALL_ONES, (np.uint64(1) << (take % 64).astype(np.uint64)) - np.uint64(1))
        return ranks[block].astype(np.int64) + np.bitwise_count(packed[block] & mask).sum(1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """Values at places."""
        i = np.atleast_1d(np.asarray(at, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(at)
        value = np.zeros(len(i), np.int64)
        for plane in self.planes:
            zeros, _, packed = plane
            bit = (packed[i // BLOCK, i % BLOCK // 64] >> (i % 64).astype(np.uint64)).astype(np.int64) & 1
            ones = self._ones(plane, i)
            i = np.where(bit == 1, zeros + ones, i - ones)
            value = value << 1 | bit
        return self.alphabet[value]

    def _numbers(self, values) -> tuple[np.ndarray, np.ndarray]:
        """Dense numbers of values, and whether there is one."""
        v = np.atleast_1d(np.asarray(values, np.int64))
        k = np.minimum(np.searchsorted(self.alphabet, v), max(0, len(self.alphabet) - 1))
        return k, (self.alphabet[k] == v) if self.n else np.zeros(len(v), bool)

    def _range(self, k: np.ndarray, start, stop) -> tuple[np.ndarray, np.ndarray]:
        """Where the lowest level keeps the occurrences of numbers k that lie in [start, stop)."""
        start, stop = (np.broadcast_to(np.asarray(x, np.int64), k.shape) for x in (start, stop))
        for j, plane in enumerate(self.planes):
            a, b = self._ones(plane, start), self._ones(plane, stop)
            bit = k >> (len(self.planes) - 1 - j) & 1
            start, stop = np.where(bit == 1, plane[0] + a, start - a), np.where(bit == 1, plane[0] + b, stop - b)
        return start, stop

    def count(self, values, start=0, stop=None) -> np.ndarray:
        """Occurrences of values within [start, stop), all arrays of one length or single numbers."""
        k, known = self._numbers(values)
        if not self.n:
            return np.zeros(len(k), np.int64)
        a, b = self._range(k, start, self.n if stop is None else stop)
        return np.where(known, b - a, 0)

    def occurrences(self, value: int) -> np.ndarray:
        """Positions of value, ascending."""
        return self.select(value, np.arange(int(self.count(value)[0])))

    def select(self, values, ranks) -> np.ndarray:
        """Positions of the occurrences of these ranks, counted from 0."""
        r = np.atleast_1d(np.asarray(ranks, np.int64))
        k, known = self._numbers(values)
        k, known = np.broadcast_to(k, r.shape), np.broadcast_to(known, r.shape)
        if not len(r):
            return r
        if not self.n or not known.all():
            raise IndexError(ranks)
        start, stop = self._range(k, 0, self.n)
        if (r < 0).any() or (r >= stop - start).any():
            raise IndexError(ranks)
        at = start + r
        for j in range(len(self.planes) - 1, -1, -1):
            bit = k >> (len(self.planes) - 1 - j) & 1
            at = self._place(self.planes[j], bit, np.where(bit == 1, at - self.planes[j][0], at))
        return at

    def _place(self, plane, bit: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Places of the bits with r equal ones before them: a binary search over blocks, then one block for each."""
        _, ranks, packed = plane
        zeros = np.arange(len(ranks)) * BLOCK - ranks
        block = np.where(bit == 1, np.searchsorted(ranks, r, "right"), np.searchsorted(zeros, r, "right")) - 1
        left = r - np.where(bit == 1, ranks[block], zeros[block])
        words = np.where(bit[:, None] == 1, packed[block], ~packed[block])
        upto = np.bitwise_count(words).cumsum(1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(1)
        each = np.arange(len(r))
        left = left - np.where(word > 0, upto[each, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[each, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (bits.cumsum(1) == left[:, None] + 1).argmax(1)
        return block * BLOCK + word * 64 + inside

    def decode(self) -> np.ndarray:
        """The whole sequence: planes are undone from the lowest to the highest."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for j, (zeros, _, packed) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(packed.view(np.uint8).ravel(), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[np.flatnonzero(~bit)] = x[:zeros]
            up[np.flatnonzero(bit)] = x[zeros:] | kind(1 << j)
            x = up
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)


def _ranks(packed: np.ndarray) -> np.ndarray:
    per = np.bitwise_count(packed).sum(1, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.uint32)


def shard_bytes(values: np.ndarray, docs: list) -> bytes:
    """One file: a matrix, and the numbers of its documents (null where there is none)."""
    matrix = WaveletMatrix.build(values).to_bytes()
    numbers = np.array([0 if d is None else d for d in docs], "<i8")
    has = np.array([d is not None for d in docs], np.uint8)
    return b"".join([b"WVS2", struct.pack("<Q", len(matrix)), matrix, struct.pack("<Q", len(docs)), numbers.tobytes(), has.tobytes()])


def open_shard(blob: bytes) -> tuple[WaveletMatrix, list]:
    if blob[:4] != b"WVS2":
        raise ValueError("not a shard")
    (size,) = struct.unpack_from("<Q", blob, 4)
    matrix = WaveletMatrix.from_bytes(memoryview(blob)[12 : 12 + size])
    (n,) = struct.unpack_from("<Q", blob, 12 + size)
    numbers = np.frombuffer(blob, "<i8", n, 20 + size).tolist()
    has = np.frombuffer(blob, np.uint8, n, 20 + size + 8 * n).tolist()
    return matrix, [d if h else None for d, h in zip(numbers, has)]


class LibraryMemo(WordMemo):
    """Ids of words by the tokenizers library, as packed bytes."""

    _open: dict[str, LibraryMemo] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.mark = max(self.tokenizer.get_vocab().values()) + 1
        self.kind, self.code = ("<u2", "H") if size < 1 << 16 else ("<u4", "I")
        self.ends = np.zeros(size, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        super().__init__()

    @classmethod
    def at(cls, path: str) -> LibraryMemo:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def raw(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), 20_000):
            found = self.tokenizer.encode_batch_fast(words[k : k + 20_000], add_special_tokens=False)
            out += [array(self.code, e.ids).tobytes() for e in found]
        return out

    def alphabetic(self, cores: list[str], step: int = 2_000) -> list[bytes]:
        """Each word of letters is one piece, so its last id is the only one that ends a word: many go in one text."""
        out = []
        for k in range(0, len(cores), step):
            part = cores[k : k + step]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer has no word ends")
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def join(self, left: bytes, right: bytes) -> bytes:
        return left + right

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values, number, n_words = self.numbered(text, b"")
        return packed_ids(values, self.kind, number, n_words)


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and return the table of them.

    Columns: part, seq (order of the shards), n_ids, blob (the file).
    """
    spark = docs.sparkSession
    ship(spark)

    def encode(batches):
        memo = LibraryMemo.at(path)
        kind = np.dtype(memo.kind)
        mark = np.array([memo.mark], kind).tobytes()
        part, seq, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            blob = shard_bytes(np.frombuffer(b"".join(parts), kind), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_ids", "blob"])

        for whole in batches:
            for batch in slices(whole, 24 << 20):
                flat, sizes = memo.encode(batch.column(1))
                stops = np.cumsum(sizes).tolist()
                for doc, a, b in zip(batch.column(0).to_pylist(), [0, *stops], stops):
                    parts += [flat[a:b].tobytes(), mark]
                    ids.append(doc)
                    held += b - a + 1
                    if held >= shard_ids:
                        yield shard()
                        seq, ids, parts, held = seq + 1, [], [], 0
        if ids:
            yield shard()

    d = docs.select("doc_id", "text")
    d = d.repartitionByRange(partitions(d), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(d.mapInArrow(lean(encode), "part int, seq int, n_ids long, blob binary"), "wavelet")


def read_shards(shards: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """What the files say of each document: part, seq, doc_id, rel_start, n_tokens, ids_crc32, first_id, n_first, next_first.

    Ends are the occurrences of the mark; ``first_id`` is found by access,
    ``n_first`` counts it in the document, and ``next_first`` selects the place
    in the document where it stands again (null if it does not).
    """
    ship(shards.sparkSession)

    def decode(batches):
        mark = LibraryMemo.at(path).mark
        for batch in batches:
            for row in batch.to_pylist():
                matrix, docs = open_shard(row["blob"])
                ends = matrix.occurrences(mark)
                if len(ends) != len(docs) or matrix.n != row["n_ids"]:
                    raise ValueError("the shard does not fit its documents")
                stops = ends + 1
                starts = np.concatenate(([0], stops[:-1]))
                first = matrix.access(starts).astype(np.int64)
                times = matrix.count(first, starts, stops)
                again, more = np.full(len(docs), -1), np.flatnonzero(times > 1)
                again[more] = matrix.select(first[more], matrix.count(first[more], 0, starts[more]) + 1) - starts[more]
                ids = matrix.decode().astype("<u4")
                ids[ends] = end_id
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(stops - starts), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, stops)], pa.int64()),
                     pa.array(np.where(first == mark, end_id, first)), pa.array(times), pa.array(again, mask=again < 0)],
                    ["part", "seq", "doc_id", "rel_start", "n_tokens", "ids_crc32", "first_id", "n_first", "next_first"],
                )

    return shards.mapInArrow(lean(decode), "part int, seq int, doc_id long, rel_start long, n_tokens long, ids_crc32 long, first_id long, n_first long, next_first long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, shard_start: ids before each shard; counts are summed by part first, so no window spans all shards."""
    meta = shards.select("part", "seq", "n_ids")
    by_part = meta.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("part", before.alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return meta.withColumn("within", within).join(by_part, "part").select("part", "seq", (F.col("part_start") + F.col("within")).alias("shard_start"))


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = write_shards(documents(spark, sf_dir), path)
    d = read_shards(shards, path).join(shard_starts(shards), ["part", "seq"])
    return d.select("doc_id", (F.col("shard_start") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32", "first_id", "n_first", "next_first")
