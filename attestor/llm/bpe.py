"""BPE encoding and decoding by a traversal of the trie of distinct words.

The distinct words of a batch, in sorted order, are the depth-first order of
their trie.  Each node keeps its *last token*: the one token t that ends there
for which the encoding of the node's string is the encoding of the shorter
prefix followed by t.  A node is computed once, from its ancestors, however
many words pass through it; a word's ids are read back along the last tokens.

A pair (u, t) may stand side by side if no merge across their border would
have happened earlier than the merges that built u's right end and t's left
end; that is found by undoing those merges from the latest back.

Defined results: null and empty texts have no ids and decode to ''; texts of
any length are encoded whole; a special token written out in a text is encoded
as that token; equal rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, lean, ship, slices
from attestor.llm.memo import WordMemo, packed_ids

END = "</w>"
#: Fixed value: the pattern of the tokenizer file, with white space spelled out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Pairs that a Python worker remembers.
MEMO_PAIRS = 1_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class TrieBPE(WordMemo):
    """Encoder and decoder for a tokenizer file with word ends."""

    most = 450_000
    _open: dict[str, TrieBPE] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.vocab: dict[str, int] = j["model"]["vocab"]
        added = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *added.items()]}
        self.rank = {}
        for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]):
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        self.longest = max(len(s.removesuffix(END)) for s in self.vocab)
        self.special = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.letters = byte_letters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.built: dict[int, tuple[int, int, int] | None | bool] = {}
        self.pairs: dict[int, bool] = {}
        self.sound = dict(self.vocab)  # tokens whose own string gives them; others leave when met
        self.tried: set[int] = set()
        super().__init__()

    @classmethod
    def at(cls, path: str) -> TrieBPE:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def made(self, token: int):
        """(left, right, rank) of the merge that makes the token, None for a single symbol, False if its own string gives other tokens."""
        if token not in self.built:
            name = self.names[token]
            bare = name.removesuffix(END)
            ids = [self.vocab[c] for c in bare]
            if name != bare:
                ids[-1] = self.vocab[bare[-1] + END]
            last = None
            while len(ids) > 1:
                found = [(self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
                if not found:
                    break
                r, k = min(found)
                last = (ids[k], ids[k + 1], r)
                ids[k : k + 2] = [self.rank[last[:2]][1]]
            self.built[token] = last if ids == [token] else False
        return self.built[token]

    def _fits(self, u: int, t: int) -> bool:
        before = len(self.rank) + 1
        while True:
            across = self.rank.get((u, t))
            if across and across[0] < before:
                return False
            left, right = self.made(u), self.made(t)
            if left and (not right or left[2] > right[2]):
                before, u = left[2], left[1]
            elif right:  # of two equal merges the left one comes first
                before, t = right[2] + 1, right[0]
            else:
                return True

    def _token(self, piece: str) -> int | None:
        """The token of a string, unless its own encoding is another."""
        t = self.sound.get(piece)
        if t is not None and t not in self.tried:
            self.tried.add(t)
            if self.made(t) is False:
                del self.sound[piece]
                return None
        return t

    def encode_parts(self, parts: list[str]) -> dict[str, list[int]]:
        """Ids of distinct strings of byte letters, in one depth-first traversal."""
        out, before, done, last, back = {}, "", 0, [0], [0]
        sound, tried, pairs, longest = self.sound, self.tried, self.pairs, self.longest
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        for word in sorted(parts):
            n = len(word)
            done = min(done, len(commonprefix((before, word))), n - 1)
            del last[done + 1 :], back[done + 1 :]
            for depth in range(done + 1, n + 1):
                end = END if depth == n else ""
                for start in range(depth - longest if depth > longest else 0, depth):
                    piece = word[start:depth] + end
                    t = sound.get(piece)
                    if t is None or (t not in tried and self._token(piece) is None):
                        continue
                    if start:
                        key = last[start] << 32 | t
                        good = pairs.get(key)
                        if good is None:
                            good = pairs[key] = self._fits(last[start], t)
                        if not good:
                            continue
                    break
                else:
                    raise ValueError(f"no encoding of {word[:depth]!r}")
                if depth < n:
                    last.append(t)
                    back.append(start)
            done, before = n - 1, word
            ids = [t]
            while start:
                ids.append(last[start])
                start = back[start]
            ids.reverse()
            out[word] = ids
        return out

    def split(self, word: str) -> list[str | int]:
        """Strings of byte letters, and ids of special tokens, of a word without ASCII white space."""
        out: list[str | int] = []
        for piece in self.cut.split(word) if self.cut and "<" in word else [word]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                text = "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
                out += map(self.lettered, self.pieces.findall(text))
        return out

    def lettered(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)

    def value(self, ids: list[int]) -> tuple[bytes, bytes]:
        return array("I", ids).tobytes(), self.decode(ids).encode()

    def alphabetic(self, cores: list[str]) -> list[tuple[bytes, bytes]]:
        parts = list(map(self.lettered, cores))
        found = self.encode_parts(parts)
        return [self.value(found[p]) for p in parts]

    def raw(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        split = list(map(self.split, words))
        found = self.encode_parts(list({p for parts in split for p in parts if isinstance(p, str)}))
        return [self.value([i for p in parts for i in ([p] if isinstance(p, int) else found[p])]) for parts in split]

    def join(self, left: tuple[bytes, bytes], right: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        return left[0] + right[0], left[1] + b" " + right[1]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces."""
        return " ".join([self.names[i] for i in ids])

    def batch(self, text: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded texts of an Arrow array of texts."""
        values, number, n_words = self.numbered(text, (b"", b""))
        ids, sizes = packed_ids([x[0] for x in values], "<u4", number, n_words)
        shown, stops = [x[1] for x in values], np.cumsum(n_words)
        some = (lambda w: [shown[k] for k in w if shown[k]]) if b"" in shown else (lambda w: [shown[k] for k in w])
        texts = [b" ".join(some(number[a:b].tolist())) for a, b in zip(stops - n_words, stops)]
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32))), pa.array(texts, pa.binary()).cast(pa.string())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of each document."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = TrieBPE.at(path)
        for whole in batches:
            for part in slices(whole, 8 << 20):
                ids, texts = bpe.batch(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids, texts], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def op6_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return d.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
