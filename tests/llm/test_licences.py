import random
import re

import pyarrow as pa

from attestor.llm import licences
from tests.llm.util import frame, odd_rows, save


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in licences.BASE.items() for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns(spark, sf, tmp_path):
    odd = [r for i, r in enumerate(odd_rows()) if r[0] is not None and i < 13]
    more = ["all rights all rights reserved reserved", "CC BY-NC cc-by cc, by", "GNU General Public License general public general public license", "cc", "by", "general public"]
    odd += [(100 + i, t, *[None] * 8) for i, t in enumerate(more)]
    for d in (sf, "/root/testdata/sf0.01", save(spark, tmp_path, odd)):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        for r in licences.op10_licence_scan(spark, d).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), r.doc_id
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_found(spark):
    wide = licences.TEMPLATES
    rows = [(i, f"Some words before. {t} Some words after.", *[None] * 8) for i, t in enumerate(t for ts in wide.values() for t in ts)]
    broken = wide["mit"][2].replace("free of charge", "without any charge").replace("sublicense", "sub-license")
    rows += [(900, broken, *[None] * 8), (901, "the of and to any of the software in the work", *[None] * 8)]
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows)).collect()}
    for i, label in enumerate(label for label, ts in wide.items() for _ in ts):
        assert label in got[i].labels.split(","), (i, label, got[i])
        span = next(s for s in got[i].spans if s.label == label)
        assert span.start >= 3 and span.stop <= got[i].n_words - 3
    assert "mit" in got[900].labels.split(",") and 0.85 <= got[900].score < 1
    assert got[901].labels == "" and got[901].score == 0


def test_matching_statistics():
    seqs = [[1, 2, 3, 4, 2, 3], [2, 3, 5, 1, 2], [7, 7, 7]]
    auto = licences.Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [2, 3, 5, 1, 2, 3, 4, 9, 7, 7, 7, 7, 2, 3, 4, 2, 3, 5]
    for i, (state, long) in enumerate(auto.statistics(text)):
        assert long == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in subs), default=0)
        if long:
            run = text[i + 1 - long : i + 1]
            want = {(k, j) for k, s in enumerate(seqs) for j in range(long, len(s) + 1) if s[j - long : j] == run}
            assert auto.ends[state] == want


def test_empty_table(spark):
    assert licences.scan(frame(spark, [])).count() == 0


def test_more_licences(spark):
    tags = ["LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "EPL-2.0", "CC-BY-ND-4.0", "Zlib", "BSD-3-Clause"]
    rows = [(i, f"see SPDX-License-Identifier: {t} here", *[None] * 8) for i, t in enumerate(tags)]
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(frame(spark, rows)).collect()}
    for i, t in enumerate(tags):
        assert {"LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "BSD-3-Clause": "bsd"}.get(t, t.lower()) in got[i], (t, got[i])
    new = {"lgpl", "agpl", "cc0-1.0", "epl-2.0", "cc-by-nd-4.0", "zlib"}
    rows = [(i, t, *[None] * 8) for i, t in enumerate(t for k, ts in licences.TEMPLATES.items() if k not in new for t in ts)]
    for r in licences.scan(frame(spark, rows)).collect():
        assert not new & set(r.labels.split(",")), r


def brute_spans(text, templates):
    """Spans without automaton or stretches: longest known run ending at each word by trying all, then each template's chain alone."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    where = {}  # run of words: (template, stop) of all its places
    for k, (_, t) in enumerate(templates):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                where.setdefault(tuple(t[i:j]), set()).add((k, j))
    long = [max((n for n in range(1, i + 2) if tuple(w[i + 1 - n : i + 1]) in where), default=0) for i in range(len(w))]
    ends = [i for i in range(len(w)) if long[i] >= licences.MIN_RUN and not (i + 1 < len(w) and long[i + 1] == long[i] + 1)]
    out = {}
    for k, (label, t) in enumerate(templates):
        chain = None  # first word, last word, place in the template, words covered
        for i in ends:
            a, b = i + 1 - long[i], i + 1
            best = None
            for stop in sorted(j for x, j in where[tuple(w[a:b])] if x == k):
                here = (a, b, stop, b - a)
                if chain and a - chain[1] <= licences.MAX_GAP and min(b - max(a, chain[1]), stop - chain[2]) > 0:
                    longer = (chain[0], b, stop, chain[3] + min(b - max(a, chain[1]), stop - chain[2]))
                    here = longer if longer[3] > here[3] else here
                best = here if best is None or here[3] > best[3] else best
            if best:
                chain = best
                cover = best[3] / len(t)
                if cover >= licences.MIN_COVER:
                    out.setdefault((label, best[0]), []).append((i, k, best[1], cover))
    final = {}
    for (label, a), found in out.items():
        b, cover = None, 0
        for _, _, stop, c in sorted(found, key=lambda x: (x[0], x[1])):
            if c >= cover:
                b, cover = stop, c
        final[label, a] = (b, cover)
    return sorted((label, a, b, c) for (label, a), (b, c) in final.items())


def test_spans_against_brute_force(spark, monkeypatch):
    """Pieces of four templates, broken and with gaps, between common words: labels, spans and score by trying everything."""
    some = {k: licences.TEMPLATES[k][:2] for k in ("apache-2.0", "mit")} | {"made": ["one two three four five six one two three seven eight nine", "one two three four nine nine one two"]}
    monkeypatch.setattr(licences, "TEMPLATES", some)
    templates = [(label, [w for w in licences.words_of(t) if w]) for label, ts in some.items() for t in ts] + [(label, p.split()) for p, label in licences.BASE.items()]
    draw, texts = random.Random(12), []
    for _ in range(200):
        parts = []
        for _ in range(draw.randrange(1, 7)):
            _, t = draw.choice(templates[:-3])
            i = draw.choice([0, 0, draw.randrange(len(t))])
            piece = t[i : i + draw.choice([len(t), draw.randrange(1, len(t) + 1)])]
            if draw.random() < 0.4:
                piece[draw.randrange(len(piece))] = draw.choice(["zzz", "two", "license"])
            parts += piece + [draw.choice(["x", "the", "one"])] * draw.randrange(0, 14)
        texts.append(" ".join(parts))
    scanner = licences.Scanner()
    rows = scanner.batch(list(range(len(texts))), pa.array(texts))
    assert sum(bool(r[8]) for r in rows) > 30
    for text, r in zip(texts, rows):
        want = brute_spans(text, templates)
        assert [(s["label"], s["start"], s["stop"]) for s in r[8]] == [x[:3] for x in want], text
        assert [s["cover"] for s in r[8]] == [x[3] for x in want]
        assert r[7] == min(1.0, max((x[3] for x in want), default=0.0)) and set(filter(None, r[6].split(","))) == {x[0] for x in want} | set(filter(None, r[5].split(",")))
