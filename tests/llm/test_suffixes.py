import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import suffixes as sx
from tests.llm.util import frame, odd_rows, save


def brute(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    """Texts with shared passages, edits, periodic runs and copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 90))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 60)))
            if r.random() < 0.3:
                k = r.randrange(len(p))
                p = p[:k] + word() + p[k:]
            if r.random() < 0.1:
                p = word() * r.randint(1, 200)
            parts.append(p)
        out.append(r.choice(out) if out and r.random() < 0.1 else r.choice([" ", "\n", ""]).join(parts))
    return out


def check(spark, texts, **options):
    rows = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    d = sx.dedup(frame(spark, rows), **options).collect()
    by = {hashlib.md5((t or "").encode()).hexdigest(): r for t, r in zip(texts, brute([(t or "").encode() for t in texts], options.get("length", 200)))}
    assert len(d) == len(by)
    for r in d:
        got = (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
        assert got == by[r.thash]


def test_equals_brute_force(spark):
    check(spark, corpus(1))
    check(spark, corpus(2), length=50, gram=12)


def test_large_groups_are_divided(spark, monkeypatch):
    """One gram in most texts, between shared and unshared bytes, and one common start of seven bytes: every level is reached."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    common, wide = "0123456789 the common line 9876543210", [some(30) for _ in range(3)]
    texts = ["common " + some(r.randint(5, 40)) + common + some(r.randint(0, 40)) for _ in range(40)]
    texts += ["common " + some(3) + r.choice(wide) + common + r.choice(wide) + some(r.randint(0, 9)) for _ in range(40)]
    texts += [common * 12, common * 12, "x" * 700, "xy" * 300, None, ""]
    monkeypatch.setattr(sx, "LARGE", 3)
    levels = []
    table = sx.gram_table
    monkeypatch.setattr(sx, "gram_table", lambda t, level, *a: levels.append(level) or table(t, level, *a))
    check(spark, texts, length=60, gram=16)
    assert levels == [0, 1, 2, 3]
    check(spark, corpus(3), length=60, gram=16)
    monkeypatch.setattr(sx, "RUN_ROWS", 7)
    check(spark, texts)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"abcdefabcxefabcdef", np.uint8)
    at = np.arange(len(data) - 5)
    want = [data.tobytes().index(data[i : i + 6].tobytes()) for i in at]
    assert sx.earliest(data, at, 6).tolist() == want
    real = sx.rolling
    monkeypatch.setattr(sx, "rolling", lambda d, n: real(d, n) & np.uint64(1))
    assert sx.earliest(data, at, 6).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.integers(0, 168), st.integers(0, 168), st.sampled_from(sx.WIDTHS))
def test_bands_divide_windows(at, back, more, width):
    first = np.array([max(0, at - max(back, more))])
    last = np.array([max(first[0], at - min(back, more))])
    k, start, a, b = sx.bands(np.array([at]), first, last, width)
    assert sorted(x for s0, s1 in zip(a, b) for x in range(s0, s1 + 1)) == list(range(first[0], last[0] + 1))
    # every window of a band covers the bytes that the band shares
    assert all(s0 <= s1 <= p and p + 200 - width + 1 <= s0 + 200 for p, s0, s1 in zip(start, a, b))


def test_many_ranges_runs_and_chunks(spark, monkeypatch):
    for k, v in (("RANGE_ROWS", 40), ("RUN_ROWS", 25)):
        monkeypatch.setattr(sx, k, v)
    check(spark, corpus(4, 120), length=50, gram=12)


def test_query(spark, sf, tmp_path):
    for d in (sf, save(spark, tmp_path)):
        rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        want = sorted(map(str, ((r.doc_id, *x) for r, x in zip(rows, brute([(r.text or "").encode() for r in rows], 200)))))
        got = sx.op3_suffix_dedup(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    out = sx.stage(spark, frame(spark))
    assert out.columns == frame(spark).columns and out.count() == len(odd_rows())
    assert sx.op3_suffix_dedup(spark, save(spark, tmp_path, [], "none")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=12), max_size=9), max_size=9))
def test_loser_tree(runs):
    coded, every = [], []
    for r in runs:
        strings = sorted(x.encode() for x in r)
        every += strings
        before = [b"", *strings]
        coded.append([(s, sx.shared_prefix(b, s, 0), None) for b, s in zip(before, strings)])
    out = list(sx.LoserTree(coded))
    assert [s for s, _, _ in out] == sorted(every)
    for (a, _, _), (b, same, _) in zip(out, out[1:]):
        assert same == sx.shared_prefix(a, b, 0)


def test_known_prefixes_are_not_compared_again():
    prefix = b"p" * 150
    runs = []
    for k in range(8):
        strings = sorted(prefix + bytes([97 + (i * 7 + k) % 26, 97 + i]) for i in range(20))
        before = [b"", *strings]
        runs.append([(s, sx.shared_prefix(b, s, 0), None) for b, s in zip(before, strings)])
    tree = sx.LoserTree(runs)
    assert len(list(tree)) == 160
    assert tree.compared < 7 * 151 + 160 * 3 * 4


def test_runs_are_decoded():
    rows = [(b"abc", b"x", b"0" * 20), (b"abd", b"", b""), (b"abd", b"y", b"2" * 20)]
    assert [(r, le, o) for r, _, (le, o) in sx.decode_run(sx.front_code(rows))] == rows


def test_rolling_hash():
    data = np.frombuffer(b"abcabcabcabdabc", np.uint8)
    for n in (1, 3, 5, 15):
        h, seen = sx.rolling(data, n), {}
        assert len(h) == len(data) - n + 1
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(bytes(data[i : i + n]), x) == x
        assert len(set(seen.values())) == len(seen)
    assert len(sx.rolling(data, 16)) == 0
