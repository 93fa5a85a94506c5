import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import packing
from tests.llm.util import frame, odd_rows, save


def padding(lengths, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in lengths.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(lengths, k):
    x = sorted(lengths)
    got = packing.boundaries(np.array(x), np.array([lengths[i] for i in x]), k)
    assert got == sorted(set(got)) and len(got) <= k and got[-1] == x[-1]
    best = min(padding(lengths, (*c, x[-1])) for r in range(min(k, len(x))) for c in itertools.combinations(x[:-1], r))
    assert padding(lengths, got) == best


def check(rows, texts, max_len, budget):
    per, by = defaultdict(list), Counter()
    for r in rows:
        per[r.doc_id].append(r)
        by[r.bucket, r.batch, r.slot] += 1
    for k, t in texts.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        own = sorted(per[k], key=lambda r: r.piece)
        assert [(r.first_token, r.n_tokens) for r in own] == [(a, min(max_len, n - a)) for a in range(0, max(n, 1), max_len)]
    assert set(by.values()) <= {1}
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches[r.bucket, r.batch].append(r)
    last = {b: max(x for y, x in batches if y == b) for b, _ in batches}
    for (b, x), own in batches.items():
        full = max(1, budget // max(1, own[0].bucket_len))
        assert sorted(r.slot for r in own) == list(range(len(own))) and (len(own) == full if x < last[b] else len(own) <= full)


def test_batches(spark, sf, tmp_path):
    for d in (sf, save(spark, tmp_path, [r for i, r in enumerate(odd_rows()) if r[0] is not None and i < 13])):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        texts = {r.doc_id: r.text for r in docs.collect()}
        check(packing.op1_packing(spark, d).collect(), texts, packing.MAX_LEN, packing.BUDGET)
        check(packing.pack(docs, max_len=100, buckets=3, budget=1000).collect(), texts, 100, 1000)


def test_many_salts(spark, monkeypatch, sf):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, packing.MAX_LEN, packing.BUDGET)


def test_pieces_hold_the_texts(spark):
    got = {}
    for r in packing.pack(frame(spark), max_len=7, with_text=True).collect():
        got.setdefault((r.doc_id, r.n_tokens >= 0), []).append(r)
    texts = Counter()
    for r in odd_rows():
        texts[r[0]] += len(r[1] or "")
    for (k, _), rows in got.items():
        assert sum(len(r.text) for r in rows) == texts[k]
        assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.n_tokens for r in rows)
    long = sorted(got[8, True], key=lambda r: r.piece)
    assert "".join(r.text for r in long) == odd_rows()[8][1] and len(long) == -(-20_000 // 7)


def test_repeats_and_empty(spark):
    assert packing.pack(frame(spark)).select("doc_id").count() >= len(odd_rows())
    assert packing.pack(frame(spark, [])).count() == 0
