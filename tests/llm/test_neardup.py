import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from attestor.llm import neardup as nd
from attestor.llm.components import components
from tests.llm.util import frame, odd_rows, save


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """For (doc_id, text): class id, links and copies of each row."""
    sets = [shingles(t) for _, t in rows]
    of = defaultdict(list)
    for k, s in enumerate(sets):
        of[s if s else k].append(k)
    kinds = [s for s in of if isinstance(s, frozenset)]
    where = defaultdict(set)
    for i, s in enumerate(kinds):
        for x in s:
            where[x].add(i)
    near = defaultdict(set)
    for i, s in enumerate(kinds):
        for j in set().union(*(where[x] for x in s)):
            if j != i and len(s & kinds[j]) >= threshold * len(s | kinds[j]) - 1e-9:
                near[i].add(j)
    label = list(range(len(kinds)))
    for i in range(len(kinds)):
        stack = [i]
        while stack:
            for j in near[stack.pop()]:
                if label[j] != label[i]:
                    label[j] = label[i]
                    stack.append(j)
    heads = {}
    for i, s in enumerate(kinds):
        ids = [rows[k][0] for k in of[s] if rows[k][0] is not None]
        heads[label[i]] = min([x for x in (heads.get(label[i]), *ids) if x is not None], default=None)
    out = []
    for k, s in enumerate(sets):
        i = kinds.index(s) if s else None
        out.append((rows[k][0], heads[label[i]] if s else rows[k][0], len(near[i]) if s else 0, len(of[s]) if s else 1))
    return out


def corpus(seed, n=150):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 120))))
    return list(enumerate(out))


def run(spark, rows):
    d = nd.near_duplicates(frame(spark, [(*r, *[None] * 8) for r in rows]))
    return sorted(map(str, (tuple(x) for x in d.select("doc_id", "class_id", "n_links", "n_copies").collect())))


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == sorted(map(str, brute(rows)))


def family(seed, n, base, edits, words):
    """Near copies of a text, some with edits in common."""
    r = random.Random(seed)
    versions = [list(base) for _ in range(3)]
    for v in versions[1:]:
        for _ in range(3):
            v[r.randrange(len(v))] = f"v{r.randrange(words)}"
    out = []
    for _ in range(n):
        w = list(r.choice(versions))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(words)}"
        out.append(" ".join(w))
    return out


def test_large_buckets_and_blocks(spark, monkeypatch):
    """Leaders, blocks and groups over a block, with a good base, with a base of nothing, and with several versions."""
    for k, v in (("SMALL", 6), ("BLOCK", 7), ("TASK_BYTES", 4_000), ("SAMPLE", 5), ("EDIT_BLOCK", 4)):
        monkeypatch.setattr(nd, k, v)
    base = [f"t{i}" for i in range(80)]
    rows = family(3, 60, base, 2, 9)
    assert run(spark, list(enumerate(rows))) == sorted(map(str, brute(list(enumerate(rows)))))
    rows += family(4, 40, [f"s{i}" for i in range(200)], 4, 5) + [t for _, t in corpus(6, 60)]
    assert run(spark, list(enumerate(rows))) == sorted(map(str, brute(list(enumerate(rows)))))
    monkeypatch.setattr(nd, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(nd, "bases", lambda sets: sets.select("component").distinct().withColumn("base", nd.F.lit(b"")))
    assert run(spark, list(enumerate(rows))) == sorted(map(str, brute(list(enumerate(rows)))))


def test_leaders_connect_what_candidates_connect(spark, monkeypatch):
    """With buckets led, split and compared in blocks, candidates connect the same classes as with brute force in large buckets."""
    monkeypatch.setattr(nd, "SMALL", 5)
    monkeypatch.setattr(nd, "BLOCK", 6)
    r = np.random.default_rng(4)
    heads = r.integers(0, 50, (4, nd.COORDS))
    keys, sketches = [], []
    for k in range(120):
        s = heads[k % 4].copy()
        at = r.choice(nd.COORDS, r.integers(0, 34), replace=False)
        s[at] = r.integers(0, 50, len(at))
        keys.append(bytes([k]) * 16)
        sketches.append([int(x) for x in s])
    classes = spark.createDataFrame(list(zip(keys, sketches)), "key binary, sketch array<int>")
    rows = classes.select(nd.F.lit(1).cast("long").alias("path"), "key", "sketch")
    edges, rest = nd.led(rows)
    pairs = [(bytes(e.u), bytes(e.v)) for e in edges.collect()] + [(bytes(e.u), bytes(e.v)) for e in nd.blocks(rest).collect()]
    near = [(keys[i], keys[j]) for i in range(120) for j in range(i) if sum(x == y for x, y in zip(sketches[i], sketches[j])) >= nd.CANDIDATE]

    def parts(edges):
        of = {k: {k} for k in keys}
        for a, b in edges:
            if of[a] is not of[b]:
                of[a] |= of[b]
                for k in of[b]:
                    of[k] = of[a]
        return {frozenset(x) for x in of.values()}

    assert set(pairs) <= set(near) | {(b, a) for a, b in near} and parts(pairs) == parts(near) and rest.count() < 120


def test_query_and_odd_rows(spark, tmp_path):
    for d in ("/root/testdata/sf0.01", save(spark, tmp_path)):
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        got = sorted(str(tuple(r)) for r in nd.op4_jaccard_join(spark, d).collect())
        assert got == sorted(map(str, brute(rows)))
    assert nd.op4_jaccard_join(spark, save(spark, tmp_path, [], "none")).count() == 0


def test_stage(spark):
    rows = corpus(4, 60)
    rows += rows[:3] + [(900, None), (901, ""), (3, "another text under an id that stands twice here")]
    out = nd.stage(spark, frame(spark, [(*r, *[None] * 8) for r in rows]))
    assert out.columns == frame(spark).columns
    want = {c for _, c, _, _ in brute(rows)}
    assert sorted(r.doc_id for r in out.collect()) == sorted([*want, 3] if 3 in want else want)
    assert nd.stage(spark, frame(spark)).count() <= len(odd_rows())


def test_pieces():
    assert nd.runs_needed() == 11 and 1 - (1 - nd.survival() ** nd.DEPTH) ** 11 >= nd.RECALL
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets])
    assert np.array_equal(nd.overlaps(sets, sets[5:]), want)
    a, b = nd.shingle_sets(pa.array(["a b c d e f g", "b c d e f"]))
    assert len(a) == 3 and len(b) == 1 and b[0] in a
    near = r.random((20, 15)) < 0.08
    got = nd.matrix_forest(near)
    assert len(got) == len(set(got)) and all(near[x, y] for x, y in got)
    groups = lambda edges: len({frozenset(g) for g in _groups(edges)})
    assert groups(got) == groups(list(zip(*np.nonzero(near))))


def _groups(edges):
    of = {}
    for x, y in edges:
        g = of.setdefault(("r", x), {("r", x)}) | of.setdefault(("c", y), {("c", y)})
        for k in g:
            of[k] = g
    return of.values()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 13] + [(100, k) for k in range(101, 130)] + [(5, 5), (3, 2)]
    d = components(spark.createDataFrame(edges, "u long, v long"))
    got = defaultdict(set)
    for r in d.collect():
        got[r.component].add(r.node)
    want = [{2, 3, *range(1, 14)}, {*range(14, 27)}, {*range(27, 40)}, {40, 41}, {*range(100, 130)}, {0, 1}]
    assert set().union(*got.values()) == {k for e in edges if e[0] != e[1] for k in e} and sum(map(len, got.values())) == len(set().union(*got.values()))
    assert {frozenset(v) for v in got.values()} <= {frozenset(v) for v in want} | {frozenset(range(13 * k + 1, 13 * k + 14)) for k in range(3)} | {frozenset([40, 41])}
    assert all(min(v) == k for k, v in got.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
