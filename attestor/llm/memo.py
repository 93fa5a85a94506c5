"""Word-by-word encoding of Arrow batches for tokenizers that drop white space."""

from __future__ import annotations

import numpy as np

from attestor.llm.common import distinct_words

#: Distinct words and cores that a Python worker remembers, and the longest such word.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 48


def latin(word: str) -> bool:
    """Characters of Latin-1 are in normal form and lower-cased one by one."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordMemo:
    """Values of distinct words, each found once for a worker.

    ``alphabetic`` gives the values of lower-case words of letters, ``raw``
    those of any words, and ``join`` that of two pieces side by side.  Latin
    words with or without a full stop or comma share the value of their letters.
    """

    most = MEMO_WORDS

    def __init__(self):
        self.memo, self.cores = {}, {}
        self.tails = dict(zip(".,", self.raw([".", ","])))

    def alphabetic(self, cores: list[str]) -> list:
        raise NotImplementedError

    def raw(self, words: list[str]) -> list:
        raise NotImplementedError

    def join(self, left, right):
        raise NotImplementedError

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        joined, rest = b"\n".join(words).decode(), []
        if not latin(joined):
            strings = joined.split("\n")
            rest = [w for w, s in zip(words, strings) if not latin(s)]
            words = [w for w, s in zip(words, strings) if latin(s)]
            joined = b"\n".join(words).decode()
        lows = joined.lower().split("\n") if words else []
        tails = [self.tails.get(s[-1]) for s in lows]
        cores = [s[:-1] if t else s for s, t in zip(lows, tails)]
        plain = list(map(str.isalpha, cores))
        if len(self.cores) > self.most:
            self.cores.clear()
        new = [c for c in set(cores).difference(self.cores) if c.isalpha()]
        self.cores.update(zip(new, self.alphabetic(new)))
        get, join = self.cores.get, self.join
        self.memo.update((w, join(get(c), t) if t else get(c)) for w, c, t, p in zip(words, cores, tails, plain) if p)
        rest += [w for w, p in zip(words, plain) if not p]
        self.memo.update(zip(rest, self.raw([w.decode() for w in rest])))
        for c in [c for c in new if len(c) > MEMO_BYTES]:
            del self.cores[c]

    def numbered(self, text, empty) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct words of an Arrow array, the number of each word, and the words of each text."""
        known, number, n_words = distinct_words(text)
        if len(self.memo) > self.most:
            self.memo.clear()
        values = list(map(self.memo.get, known))
        missing = [k for k, x in enumerate(values) if x is None]
        self.learn([known[k] for k in missing if known[k]])
        for k in missing:
            values[k] = self.memo.get(known[k], empty)
            if len(known[k]) > MEMO_BYTES:
                del self.memo[known[k]]
        return values, number, n_words


def packed_ids(packed: list[bytes], kind: str, number: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each text."""
    from attestor.llm.common import gathered

    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(kind).itemsize
    ids, long = gathered(np.frombuffer(b"".join(packed), kind), np.cumsum(sizes) - sizes, sizes, number)
    before, stops = np.concatenate(([0], np.cumsum(long))), np.cumsum(n_words)
    return ids, before[stops] - before[stops - n_words]
