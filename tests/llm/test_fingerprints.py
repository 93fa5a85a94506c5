import hashlib
import math
import random
from collections import Counter

import xxhash

from attestor.llm import fingerprints as fp
from tests.llm.util import frame, odd_rows, save


def brute_likeness(a, b, k=fp.K):
    """Likeness of two lists of (position, hash): one-to-one pairs, passages, and the longer of both readings in order."""
    places = [{}, {}]
    for x, d in zip((a, b), places):
        for p, h in x:
            d.setdefault(h, []).append(p)
    pairs = sorted((q - p, p) for h in places[0].keys() & places[1].keys() for p, q in zip(places[0][h], places[1][h]))
    runs = []
    for shift, at in pairs:
        if runs and runs[-1][-1][0] == shift and at - runs[-1][-1][1] <= k:
            runs[-1].append((shift, at))
        else:
            runs.append([(shift, at)])
    there = [at + shift for at, shift in sorted((at, shift) for r in runs if len(r) > 1 or min(len(a), len(b)) == 1 for shift, at in r)]
    top, forward = -1, 0
    for x in there:
        top, forward = max(top, x), forward + (x > top)
    low, backward = 1 << 60, 0
    for x in reversed(there):
        low, backward = min(low, x), backward + (x < low)
    both = max(forward, backward)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def expect(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 2
        out[k] = t[: len(t) - cut] + nxt[:cut]
    return out


def test_edited_and_likeness(spark, sf, tmp_path):
    odd = [r for i, r in enumerate(odd_rows()) if r[0] is not None and i < 13]
    for d in (sf, save(spark, tmp_path, odd)):
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        want = expect(list(texts.items()))
        got = fp.op2_fingerprints(spark, d).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.n_chars == len(texts[r.doc_id])
            assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest(), r.doc_id
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if want[r.doc_id] == texts[r.doc_id]:
                assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        by_text = {}
        for r in got:
            assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_syncmers_are_context_free(spark):
    text = " ".join(f"w{i * i % 101}" for i in range(120))
    rows = [(1, text), (2, "left of it " + text + " right of it")]
    d = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", fp.anchors(fp.F.col("text")).alias("a"))
    a, b = ({(x.pos, x.hash) for x in r.a} for r in d.orderBy("doc_id").collect())
    assert {(p + 3, h) for p, h in a} <= b and len(a) > 30


def test_null_ids_and_empty(spark, tmp_path):
    assert fp.op2_fingerprints(spark, save(spark, tmp_path)).count() == len(odd_rows())
    assert fp.op2_fingerprints(spark, save(spark, tmp_path, [], "none")).count() == 0
    assert fp.fingerprints(frame(spark)).count() == len(odd_rows())


def test_all_anchors_count_by_position(spark, tmp_path):
    """Few edits and a short shared passage show in texts of 20,000 words; values against the same matching in Python."""
    r = random.Random(5)
    many = [f"w{r.randrange(3000)}" for _ in range(20_000)]
    other = [f"v{r.randrange(3000)}" for _ in range(20_000)]
    edited = [f"x{i}" if i in (5_000, 12_000) else w for i, w in enumerate(many)]
    quoting = other[:700] + many[9_000:9_120] + other[700:]
    texts = [many, edited, quoting, ["dup"] * 300, ["dup"] * 200, ["of", "four", "words", "here"], ["of", "four", "words", "here"], []]
    rows = [(100 - i, " ".join(t), *[None] * 8) for i, t in enumerate(texts)]
    d = save(spark, tmp_path, rows)
    got = {x.doc_id: x for x in fp.op2_fingerprints(spark, d).collect()}
    anchors = {x.doc_id: [(a.pos, a.hash) for a in x.fp] for x in fp.fingerprints(frame(spark, rows)).collect()}
    for k, a in anchors.items():
        assert got[k].fingerprint == "".join(f"{h:010X}{p - (a[i - 1][0] if i else 0):X}" for i, (p, h) in enumerate(a))
        b = anchors.get(k - 1, anchors[100])
        assert math.isclose(got[k].near_next, brute_likeness(a, b)), k
    assert len(anchors[100]) > 8_000 and got[100].fingerprint != got[99].fingerprint
    assert 0.99 < got[100].near_next < 1 and 6_990 <= got[100].next_passage <= 7_999
    assert 0 < got[99].near_next < 0.01 and 110 <= got[99].next_passage <= 120
    assert got[97].near_next == 196 / 296 and got[97].next_passage == 200
    assert got[95].near_next == 1 and got[95].next_passage == 4 and got[94].near_next == got[94].next_passage == 0


def test_order_of_passages_matters(spark, tmp_path):
    """A text with one word changed, one with a passage put in, one with its thirds in another order, and a foreign one."""
    r = random.Random(11)
    t = [f"w{r.randrange(10_000)}" for _ in range(600)]
    texts = [t, [*t[:300], "new", *t[301:]], t, [*t[:200], *[f"n{i}" for i in range(40)], *t[200:]], t, t[400:] + t[200:400] + t[:200], t, [f"z{i}" for i in range(600)]]
    got = {x.doc_id: x.near_next for x in fp.op2_fingerprints(spark, save(spark, tmp_path, [(100 - i, " ".join(x), *[None] * 8) for i, x in enumerate(texts)])).collect()}
    assert got[100] > 0.97 and got[98] > 0.85 and 0.15 < got[96] < 0.35 and got[94] == 0


def chained(words):
    """Hash of several words as the engine's xxhash64 of several columns: each hash seeds the next."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h


def brute_anchors(text, k=fp.K, s=fp.S):
    w = text.split()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    if 0 < len(w) < k:
        return [(0, None)]
    out = []
    for i in range(len(w) - k + 1):
        inner = [signed(chained(w[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chained(w[i : i + k]) & fp.MASK))
    return out


def test_fingerprints_equal_brute_force(spark, sf):
    """Syncmers of every whole document, and likeness to the next one by the same matching in Python."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: brute_anchors(r.text or "") for r in rows}
    found = {r.doc_id: [(a.pos, a.hash) for a in r.fp] for r in fp.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for k, a in want.items():
        assert found[k] == a or [p for p, _ in a] == [0] == [p for p, _ in found[k]] and a[0][1] is None, k
    order = sorted(want, reverse=True)
    got = {r.doc_id: r for r in fp.op2_fingerprints(spark, sf).select("doc_id", "near_next").collect()}
    for k, nxt in zip(order, [*order[1:], order[0]]):
        assert math.isclose(got[k].near_next, brute_likeness(found[k], found[nxt])), k


def test_neighbours_over_buckets(spark, monkeypatch):
    """Buckets of about two rows: repeated and null ids, and exact repeats, keep one ring of all rows."""
    monkeypatch.setattr(fp, "BUCKET_ROWS", 2)
    r = random.Random(3)
    rows = [(r.choice([None, 7, 7, r.randrange(-50, 50), (1 << 63) - 1, -(1 << 63)]), f"t{k}") for k in range(60)] + [(7, "same")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fp.with_next(d).collect()

    def key(x):
        h = xxhash.xxh64_intdigest(x[1].encode(), seed=42)
        return (x[0] is None, -(x[0] or 0), h - (1 << 64) if h >> 63 else h)

    ring = sorted(rows, key=key)
    want = Counter((i, t, ring[(k + 1) % len(ring)][1]) for k, (i, t) in enumerate(ring))
    assert Counter(map(tuple, got)) == want
    assert fp.with_next(d.limit(0)).count() == 0
