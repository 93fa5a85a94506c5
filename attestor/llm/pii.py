"""Format-preserving pseudonyms for personal data.

Finders propose values, validators (checksums, ranges, calendars) confirm them,
and each confirmed value is replaced by another of the same format: its number
is permuted by a keyed Feistel network over the set of values of that format.
Equal values, however they are punctuated, get equal pseudonyms in every
document; different values get different ones; the key is needed to go back.

The key is the setting KEY_SETTING of the session.  Where it is unset, each Spark
application draws a secret key of its own, which is stored nowhere: values stay
linked within the application, and nobody can go back.

Kinds: e-mail addresses, IPv4 addresses, telephone numbers, payment cards
(Luhn), US social security numbers, IBANs (mod 97), dates, access keys and
passwords.  A card or IBAN is also found where a number or word follows that
could belong to it, or a number stands before it.

Defined results: null text stays null with no findings; text without a finding
is returned as it is, whatever its length; equal rows give equal rows; an empty
table gives none; other columns pass through :func:`pseudonymise` untouched.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, lean, ship, slices

KEY_SETTING = "spark.attestor.pseudonym.key"
ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
MONTHS = "january february march april may june july august september october november december".split()


class Permuter:
    """Keyed permutations of range(n): balanced Feistel rounds, walked until the value is in range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, value: int, bits: int) -> int:
        need = -(-bits // 8)
        data, out = value.to_bytes(need, "big"), b""
        while len(out) < need:
            out += hashlib.blake2b(data, key=self.key, person=bytes([r, len(out) // 64]), salt=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
        return int.from_bytes(out[:need], "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ self._round(tweak, r, left, bits), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(tweak, r, right, bits)
        return left << bits | right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, f"{tweak}/{n}".encode(), back)
            if x < n:
                return x

    def spell(self, text: str, tweak: str, back: bool = False) -> str:
        """Permute the letters and digits of a string within their classes; other characters stay."""
        sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), None) for c in text]
        x, n = 0, 1
        for c, s in zip(text, sets):
            if s:
                x, n = x * len(s) + s.index(c), n * len(s)
        x, out = self.permute(x, n, f"{tweak}/{''.join('-' if s is None else s[0] for s in sets)}", back), []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                x, k = divmod(x, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))


def refill(shape: str, digits: str) -> str:
    """Put digits in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_sum(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def luhn(digits: str) -> bool:
    return luhn_sum(digits) == 0


def walk(step: Callable[[str], str], start: str, good: Callable[[str], bool]) -> str:
    """Cycle-walk: from a good value the permutation meets a good value again, at the latest itself."""
    x = step(start)
    while not good(x):
        x = step(x)
    return x


def email(m, p: Permuter, back: bool) -> str:
    local, _, host = m.rpartition("@")
    host, dot, top = host.rpartition(".")
    return p.spell(local.lower(), "local", back) + "@" + p.spell(host.lower(), "host", back) + dot + top


def ipv4(m, p: Permuter, back: bool) -> str | None:
    parts = list(map(int, m.split(".")))
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
        return None
    x = p.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def card(m, p: Permuter, back: bool) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or len(set(d)) == 1 or not luhn(d):
        return None
    # the sum over the places in between is kept: a number that follows then makes a valid longer card of both or of neither
    odd = luhn_sum(d + "0")

    def whole(x: str) -> str:
        return x + str(-luhn_sum(x + "0") % 10)

    body = walk(lambda x: str(p.permute(int(x), 10 ** (len(d) - 1), "card", back)).zfill(len(d) - 1), d[:-1], lambda x: x[0] in "23456" and luhn_sum(whole(x) + "0") == odd)
    return refill(m, whole(body))


#: The ways cards are printed.
PRINTED = re.compile(r"\d{13,19}|(?:\d{4}[ \-]){3,4}\d{1,4}|\d{4}[ \-]\d{6}[ \-]\d{4,5}")


def card_ends(m: str, inner: bool) -> list[int]:
    """Lengths at which a card may end in a match: all of it, or before a separator; ``inner``, after another number, only as cards are printed."""
    ends = [len(m), *[i for i in range(len(m) - 1, 12, -1) if m[i] in " -"]]
    return [n for n in ends if PRINTED.fullmatch(m, 0, n)] if inner else ends


def good_nanp(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789"


def phone(m, p: Permuter, back: bool) -> str | None:
    d = re.sub(r"\D", "", m)
    if m.startswith("+") and d[0] != "1":
        cc = d[:2]
        rest = d[2:]
        if not 7 <= len(rest) <= 13:
            return None
        return refill(m, cc + str(p.permute(int(rest), 10 ** len(rest), f"phone{cc}", back)).zfill(len(rest)))
    lead, rest = d[:-10], d[-10:]
    if len(rest) < 10 or lead not in ("", "1"):
        return None
    good = good_nanp(rest)
    if not good and not re.match(r"\+1|\(", m):  # +1 or brackets show a telephone number, whatever its area code
        return None
    return refill(m, lead + walk(lambda x: str(p.permute(int(x), 10**10, "nanp", back)).zfill(10), rest, lambda x: good_nanp(x) == good))


def good_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(m, p: Permuter, back: bool) -> str | None:
    d = re.sub(r"\D", "", m)
    return refill(m, walk(lambda x: str(p.permute(int(x), 10**9, "ssn", back)).zfill(9), d, good_ssn)) if good_ssn(d) else None


def mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m, p: Permuter, back: bool) -> str | None:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or mod97(s[4:] + s[:4]) != 1:
        return None
    body = p.spell(s[4:], "iban" + s[:2], back)
    whole = iter(s[:2] + str(98 - mod97(body + s[:2] + "00")).zfill(2) + body)
    return "".join(c if c == " " else next(whole) for c in m)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}


def iban_ends(m: str, inner: bool) -> list[int]:
    """Lengths at which an IBAN may end in a match: its country's, all of it, or before a separator."""
    places = [i + 1 for i, c in enumerate(m) if c != " "]
    n = IBAN_LENGTHS.get(m[:2], len(places))
    return [*places[n - 1 : n], len(m), *[i for i in range(len(m) - 1, 14, -1) if m[i] == " "]]


def day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d) if 1900 <= y < 2100 else None
    except ValueError:
        return None


def moved(when: date, p: Permuter, back: bool) -> date:
    return FIRST_DAY + timedelta(p.permute((when - FIRST_DAY).days, DAYS, "date", back))


def iso_date(m, p: Permuter, back: bool) -> str | None:
    y, sep, mo, _, d = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", m).groups()
    when = day(int(y), int(mo), int(d))
    return moved(when, p, back).strftime(f"%Y{sep}%m{sep}%d") if when else None


def short_date(m, p: Permuter, back: bool) -> str | None:
    """Day and month as far as they can be told: a first number over 12, or a full stop, means day first."""
    a, sep, b, _, y = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", m).groups()
    day_first = sep == "." or int(a) > 12
    when = day(int(y), int(b), int(a)) if day_first else day(int(y), int(a), int(b))
    if not when:
        return None

    def step(x: str) -> str:
        new = moved(date.fromisoformat(x), p, back)
        return new.isoformat()

    # a date that would be read with day and month the other way round is walked on, so that going back reads the same
    new = date.fromisoformat(walk(step, when.isoformat(), lambda x: sep == "." or (date.fromisoformat(x).day > 12) == day_first or not day_first))
    first, second = (new.day, new.month) if day_first else (new.month, new.day)
    return f"{first:02d}{sep}{second:02d}{sep}{new.year}"


def named_date(m, p: Permuter, back: bool) -> str | None:
    words = re.findall(r"[A-Za-z]+|\d+", m)
    name = next(w for w in words if w.isalpha())
    d, y = (int(w) for w in words if w.isdigit())
    when = day(y, MONTHS.index(name.lower()) + 1, d)
    if not when:
        return None
    new = moved(when, p, back)
    shown = MONTHS[new.month - 1]
    shown = shown.upper() if name.isupper() else shown.capitalize() if name[0].isupper() else shown
    out = m.replace(name, "\0", 1).replace(words[-1], "\1").replace(words[0] if words[0].isdigit() else words[1], "\2", 1)
    return out.replace("\0", shown).replace("\1", str(new.year)).replace("\2", str(new.day))


def access_key(m, p: Permuter, back: bool) -> str:
    return m[:4] + p.spell(m[4:], "access", back)


def secret(m, p: Permuter, back: bool) -> str:
    at = re.match(r"\w+\s*[:=]\s*[\"']?", m).end()
    return m[:at] + hexed(m[at:], p, back)


def hexed(m, p: Permuter, back: bool) -> str:
    body = m.strip("\"'")
    for digits, style in (("0-9a-f", "x"), ("0-9A-F", "X")):
        if re.fullmatch(f"[{digits}]+", body):
            x = p.permute(int(body, 16), 16 ** len(body), "hex", back)
            return m.replace(body, f"{x:0{len(body)}{style}}")
    return p.spell(m, "secret", back)


#: Kinds in order of precedence: (kind, pattern, permutation).
KINDS = [
    ("secret", r"\b(?i:password|passwd|pwd|secret|token|api_?key)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{6,}", secret),
    ("access_key", r"\bAKIA[0-9A-Z]{16}\b", access_key),
    ("hex_key", r"[\"'](?:[0-9a-f]{32,64}|[0-9A-F]{32,64})[\"']", hexed),
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}\b", email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b", iban),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", ipv4),
    ("date", r"(?<![\d\-/.])(?:19|20)\d\d([\-/])\d{1,2}\1\d{1,2}(?![\d\-/])", iso_date),
    ("date", r"(?<![\d\-/.])\d{1,2}([\-/.])\d{1,2}\1(?:19|20)\d\d(?![\d\-/])", short_date),
    ("date", r"\b(?:\d{1,2} (?i:" + "|".join(MONTHS) + r") (?:19|20)\d\d|(?i:" + "|".join(MONTHS) + r") \d{1,2}, (?:19|20)\d\d)\b", named_date),
    ("card", r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?!\d)", card),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", ssn),
    ("phone", r"(?<![\w+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\- ]\d{4}(?!\d)|(?<![\w+])\+[2-9]\d(?:[ .\-]?\d){7,12}(?!\d)", phone),
]
COMPILED = [(k, re.compile(p), f) for k, p, f in KINDS]
#: Kinds that a following word or number can be taken for a part of: where a value may end in a match.
ENDS = {"card": card_ends, "iban": iban_ends}
#: More characters than a match of these kinds has.
REACH = 64
#: A text without any of these has no finding; every pattern needs a digit, an @, a key word, AKIA or quoted hexadecimal letters.
MAY_HAVE = r"[\p{Nd}@]|AKIA|[\"'][A-Fa-f]{32}|(?i:password|passwd|pwd|secret|token|api_?key)"


def find(text: str, p: Permuter, back: bool = False) -> list[tuple[int, int, str, str]]:
    """Validated, non-overlapping findings: start, stop, kind, pseudonym; kinds earlier in the list win."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray()
    for kind, pattern, change in COMPILED:
        ends, at = ENDS.get(kind), 0

        def first(text: str, at: int, shift: int = 0):
            """The first confirmed value from ``at`` on; ``shift`` is the place of text[0] in the whole text."""
            while m := pattern.search(text, at):
                a, at = m.start(), m.start() + 1 if ends else m.end()
                inner = a > 1 and text[a - 1] == " " and text[a - 2].isdigit() and not any(taken[a - 2 + shift : a - 1 + shift])
                for n in ends(m.group(), inner) if ends else [len(m.group())]:
                    if not any(taken[a + shift : a + n + shift]) and (new := change(m.group()[:n], p, back)) is not None:
                        return a, a + n, new
            return None

        while got := first(text, at):
            a, b, new = got
            low = max(at, a - REACH)
            start = max(low - 2, 0)
            # a pseudonym that would be read with other bounds beside its neighbours is walked on, so that going back reads the same
            while ends and (first(text[start:a] + new + text[b : b + REACH], low - start, start) or (0, 0))[:2] != (a - start, b - start):
                new = change(new, p, back)
            taken = taken or bytearray(len(text))
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind, new))
            at = b
    return sorted(found)


def replaced(text: str, found) -> str:
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or else this application's own."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    sc = spark.sparkContext
    if not hasattr(sc, "_attestor_key"):
        sc._attestor_key = secrets.token_bytes(32)
    return sc._attestor_key


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes | None = None, column: str = "text", found: str = "pii_found", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``column`` and a further column ``found``: array<struct<start,stop,kind>> (places in the input text)."""
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    key = session_key(docs.sparkSession) if key is None else key
    names = docs.columns
    at = names.index(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(found, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("kind", T.StringType())])))])

    def run(batches):
        permuter = Permuter(key)
        for whole in batches:
            for part in slices(whole):
                text = part.column(at).cast(pa.string())
                maybe = pc.fill_null(pc.match_substring_regex(text, MAY_HAVE), False)
                hits = [i for i, x in enumerate(maybe.to_pylist()) if x]
                new, places = {}, [[] if x else None for x in text.is_valid().to_pylist()]
                for i in hits:
                    t = text[i].as_py()
                    if rows := find(t, permuter, back):
                        new[i] = replaced(t, rows)
                        places[i] = [{"start": a, "stop": b, "kind": k} for a, b, k, _ in rows]
                if new:
                    mask = pa.array([i in new for i in range(len(text))])
                    text = pc.replace_with_mask(text, mask, pa.array([new[i] for i in sorted(new)], pa.string()))
                columns = [text if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(places, FOUND)], [*part.schema.names, found])

    return docs.mapInArrow(lean(run), schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: the columns of ``docs``, with pseudonyms in the text; n_chars follows the text."""
    names = docs.columns
    free = next(n for n in (f"pii_found{'_' * k}" for k in range(99)) if n not in names)
    d = pseudonymise(docs, found=free)
    return d.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = list(dict.fromkeys(k for k, _, _ in KINDS))

    def count(kind: str):
        return F.size(F.filter("pii_found", lambda x: x["kind"] == kind))

    counts = [F.coalesce(count(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds]
    return d.select("doc_id", "text", F.coalesce(F.size("pii_found"), F.lit(0)).cast("long").alias("n_found"), *counts)
