import re
from collections import Counter

import duckdb

from attestor.llm import quality
from tests.llm.util import frame, odd_rows, save


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def check(rows, texts):
    assert sorted(map(str, rows.keys())) == sorted(map(str, texts.keys()))
    for k, t in texts.items():
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), k
        assert not (r.kept and r.base_failed)


def test_base_figures(spark, sf, tmp_path):
    for d in (sf, save(spark, tmp_path)):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        check({r.doc_id: r for r in quality.op9_quality_rules(spark, d).collect()}, texts)


def test_verdict(spark):
    prose = " ".join(f"The clause{i} stands{i} here{i}, as written{i}." for i in range(30))
    cases = {
        0: (prose, True),
        1: (prose + "\nHome | About | News | Contact | Help\nWe use cookies. Accept cookies", True),
        2: (" | ".join(f"item{i}" for i in range(80)) + "\n" + prose[:200], False),
        3: ("\n".join(f"SALE!! now{i}!! BUY!! it{i}%% $$$" for i in range(40)), False),
        4: (prose + "\nHeading without a mark\n" + prose[::-1] + ".", True),
    }
    rows = [(k, t, "en", "s", len(t), None, None, 1, 1, 1) for k, (t, _) in cases.items()]
    got = {r.doc_id: r for r in quality.assess(frame(spark, rows)).collect()}
    assert {k: r.kept for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}
    assert got[1].clean_text == prose
    kept = quality.clean(spark, frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id: r.n_chars for r in kept.collect()}[1] == len(prose)


def test_empty_table(spark):
    assert quality.assess(frame(spark, [])).count() == 0
    assert quality.clean(spark, frame(spark, [])).count() == 0


def test_query_equals_sql(spark, tmp_path):
    """Figures, verdicts and lost characters of every whole document, line rules included, against SQL."""
    lines = ["a | b | c | d", "one › two › three four", "x" * 30, "no closing mark", "short. ", "ends here)\t", "!!! ??? {x}", "a^b=c~d", "We use cookies. Accept all cookies", "it's PRIVACY POLICY time for all of us here", "", "  "]
    prose = [" ".join(f"word{i}{j}" for j in range(9)) + "." for i in range(40)]
    odd = odd_rows()[:13] + [(100 + k, "\n".join([*prose[k : k + 8], *lines[: k % 13], *lines[: (3 * k) % 5], *["see home | about | news | contact now"] * (k % 4 * 4)]), *[None] * 8) for k in range(26)]
    for d in ("/root/testdata/sf0.01", save(spark, tmp_path, [r for r in odd if r[0] is not None])):
        con = duckdb.connect()
        at = d + "/documents.parquet"
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at if d.startswith('/root/testdata') else at + '/*.parquet'}')")
        want = con.execute(quality.OP9_SQL)
        names = [x[0] for x in want.description]
        got = quality.op9_quality_rules(spark, d)
        assert got.columns == names
        assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    assert {r.kept for r in got.where("doc_id >= 100").collect()} == {True, False}
