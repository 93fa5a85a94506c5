"""Damage, faults and cheapest edits against a plain dynamic programme and a search of all edits."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from attestor.llm import conversations as c

SOUND = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    return out


def faulty(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(c.BLANK if not end else c.REPEATED if (role, text) in seen else c.CUT if end[-1] not in ".!?" else c.SOUND)
        seen.add((role, text))
    return out


def plain(initials, faults):
    """The least (cost, audit) by a dynamic programme over pattern states 0, s, u, a."""

    def closed(d):
        for _ in range(3):
            for x, y in [(0, "u"), ("s", "u"), ("a", "u"), ("u", "a")]:
                if x in d:
                    d[y] = min(d.get(y, (1 << 60, "")), (d[x][0] + 5, d[x][1] + "I"))
        return d

    d = closed({0: (0, "")})
    for initial, fault in zip(initials, faults):
        e = {x: (k + 2, a + "D") for x, (k, a) in d.items()}
        if fault not in (c.BLANK, c.REPEATED):
            charge = 5 * (fault == c.CUT)
            for x, (k, a) in d.items():
                fits = "a" if x == "u" else "u"
                options = [(fits, k + 1 + charge, a + "R")]
                if initial == fits or (initial == "s" and x == 0):
                    options.append((initial, k + charge, a + "K"))
                for y, cost, audit in options:
                    e[y] = min(e.get(y, (1 << 60, "")), (cost, audit))
        d = closed(e)
    return min(d[x] for x in (0, "a") if x in d)


def expected(rows):
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0)
    found = {k: list(g) for k, g in groupby(sorted(damage(rows), key=key), key=lambda r: r[0])}
    for conv in {r[0] for r in rows}:
        own = sorted(found.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults = faulty(own)
        cost, audit = plain([r[2][:1] for r in own], faults)
        known = [r[1] for r in own if r[1] is not None]
        result = list(c.applied(audit, [(r[2], r[3]) for r in own]))
        assert SOUND.fullmatch("".join(r[:1] for r, _ in result))
        text = "\n".join(f"{r}:{t}" for r, t in result)
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count(c.BLANK), faults.count(c.REPEATED), faults.count(c.CUT), sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_search_against_dynamic_programme(block):
    draw = random.Random(block)
    for n in [*range(9)] * 30 + [40, 60]:
        initials = [draw.choice("suaa?u") for _ in range(n)]
        faults = [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        symbols = "".join(c.symbol("sua?".index(x), f) for x, f in zip(initials, faults))
        assert c.cheapest(symbols, block) == plain(initials, faults)


def test_every_edit_sequence():
    """The search against all sequences of edits of short conversations."""

    def every(initials, faults, at=0, state=0, cost=0, audit="", inserts=0):
        if at == len(initials) and state in (0, 3):
            yield cost, audit
        if inserts < 3:
            yield from every(initials, faults, at, c.added(state), cost + 5, audit + "I", inserts + 1)
        if at < len(initials):
            yield from every(initials, faults, at + 1, state, cost + 2, audit + "D", inserts)
            if faults[at] < 2:
                yield from every(initials, faults, at + 1, c.added(state), cost + 1 + 5 * faults[at], audit + "R", inserts)
                if (to := c.kept(state, "sua?".index(initials[at]))) is not None:
                    yield from every(initials, faults, at + 1, to, cost + 5 * faults[at], audit + "K", inserts)

    draw = random.Random(5)
    for _ in range(150):
        n = draw.randrange(6)
        initials, faults = [draw.choice("sua?") for _ in range(n)], [draw.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        symbols = "".join(c.symbol("sua?".index(x), f) for x, f in zip(initials, faults))
        assert c.cheapest(symbols) == min(every(initials, faults))


def test_heuristic_never_exceeds_what_is_left():
    draw = random.Random(6)
    for _ in range(100):
        initials, faults = [draw.choice("sua?") for _ in range(8)], [draw.randrange(4) for _ in range(8)]
        symbols = "".join(c.symbol("sua?".index(x), f) for x, f in zip(initials, faults))
        assert all(c.floors(symbols)[k] <= min(c.search(symbols[k:], s, c.ENDS)[0] for s in range(4)) for k in range(9))


def odd_rows():
    draw = random.Random(7)
    rows = [(k, t, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(["Yes. ", "No", "What?", " \t\n", None, "ä.\x0b", "same.", "same."])) for k in range(60) for t in range(draw.randrange(9))]
    rows += [(100, t // 2, "user" if t % 2 else "assistant", f"text {t}.") for t in range(700)]  # longer than a block
    rows += [(101, None, "user", "q."), (101, None, "assistant", "r."), (101, 5, "user", "q."), (None, 1, "user", "Hm."), (None, None, None, None), (102, 3, "user", "again."), (102, 3, "user", "again."), (102, 3, "user", "again.")]
    rows += [(103, 1, "user", "long " * 50_000 + "."), (103, 2, "assistant", "w" * 30_000)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gaps int, audit string").repartition(4)
    assert sorted(map(tuple, c.summary(table).collect()), key=str) == expected(rows)
    monkeypatch.setattr(c, "FRAGMENT", 2)
    assert c.summary(table).exceptAll(c.summary(table)).count() == 0


def test_repaired_rows(spark):
    rows = odd_rows()
    found = {}
    for r in c.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        found.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for conv, *_, digest in expected(rows):
        own = sorted(found.get(conv, []))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == digest


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.summary(none).count() == 0 and c.repaired(none).count() == 0
