"""Bucket CRCs, gains, weights and ranks against brute force on n-gram strings."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest

from attestor.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text, max_n):
    w = WORD.findall(lower(text))
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, max_n, buckets, seed, percent, least):
    def counts(texts):
        out = [0] * buckets
        for x in texts:
            for f in runs(x, max_n):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for key, text in rows:
        f = runs(text, max_n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(lower(text))) >= least])
    fits = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(fits[: len(fits) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_crcs_of_runs(max_n):
    texts = ["a bc Def", None, "", "one", "Ärger 12 x-y_z A", "w" * 30_000 + " tail", "..."]
    found, words = importance.feature_crcs(pa.array(texts, pa.string()), max_n)
    for n, (crc, count) in enumerate(found, 1):
        expected = [[x for x in runs(t, max_n) if x.count(" ") == n - 1] for t in texts]
        assert count.tolist() == [len(x) for x in expected]
        assert crc.tolist() == [zlib.crc32(f.encode()) for x in expected for f in x]
    assert words.tolist() == [len(runs(t, 1)) for t in texts]


@pytest.mark.parametrize("max_n, buckets, percent", [(1, 97, 40), (3, 1000, 10), (2, 1, 100)])
def test_against_brute_force(spark, max_n, buckets, percent):
    rows = [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 40))) for k in range(120)]
    rows += [(None, None), (None, "w1 " * 30), (500, ""), (501, "w1 w2 " * 3_000), (3, rows[3][1]), (39, rows[39][1]), (39, rows[39][1]), (-7, "Été ÉTÉ x! Y? z " * 9)]
    target = ["w1 w2 w3", None, "", "w5 w5 été"]
    docs = spark.createDataFrame([(k, x, "a", 1) for k, x in rows], "doc_id long, text string, weight string, part int").repartition(3)
    found = importance.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), max_n, buckets, "s", percent, 20)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, target, max_n, buckets, "s", percent, 20)


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c")], "doc_id long, text string")
    rows = [(1, "a b " * 20), (2, "c")]
    assert sorted(map(tuple, importance.resampled(some, none, percent=100).collect()), key=str) == brute(rows, [], 1, 10_000, "2024", 100, 20)
