"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches on folded text.

Folding: compatibility forms and accents go to their base letters, letters of
other scripts that look Latin to those, invisible and combining characters
away; digits and symbols that stand for letters (``1d10t``, ``$tupid``) become
these where they touch a letter.  1, ! and | may stand for i or l, so l is folded
to i in lexicon and text alike.  A run of digits at the end of a word is read both
ways.  A term counts between characters that are no letters, with or without a
plural s or es; places inside an exception phrase (``trash can``) do not count.

The sum of weights is divided by a power of the length in hundreds of words and
turned into a probability by a logistic curve; power and curve are fitted.

Learning sees text and ``labels.toxic`` of documents whose crc32(doc_id) mod 4 is
not 2: about ``SAMPLE`` of them, half of each class, taken by a hash of the id, a
documented bound.  Of texts with the same sketch, near copies mostly, one counts.
A word enters the lexicon where even the lower bound of the odds that it speaks for
toxic is ``LEAST_ODDS``, at most ``LEXICON`` of them; a beginning of words does so
where it holds for clearly more texts than any single word that begins so.  The
fixed seed terms have a prior weight, which evidence replaces.  A neighbour that
leaves a term's share of toxic texts at the base rate makes an exception phrase.

Defined results: null and empty texts have no hit and get the curve's value for
none; whole texts count, however long; of several labels of one id the largest
counts, of several texts of one id the least is learned from; without labels the
seed terms and a fixed curve decide; equal rows give equal rows; an empty table
gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import discard, documents, lean, ship, slices, texts_of, written
from attestor.llm.language import is_held_out

#: Letters of other scripts, and stroked or dotless ones, that look like Latin letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝвкмнтαοριεκντυχηβγıłøđɑɡƒ", "aeopcyxijsdhqwbkmhtaopiekvtuxnbyilodagf"))
#: Digits and symbols that stand for letters.
STANDS_FOR = dict(zip("0123456789@$!|+€", "oizeasgtbgasiite"))
#: Terms that count before anything is learned, and phrases in which they do not.
SEEDS = "asshole bastard bitch bullshit clown cretin crap damn degenerate dimwit disgusting dumbass filth freak garbage idiot imbecile jerk loser lunatic maggot moron nitwit parasite pathetic pervert pig psycho rat retard scum shit slut stupid subhuman trash ugly vermin weirdo whore worthless".split()
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "garbage can", "garbage collection", "garbage collector", "clown fish", "idiot proof", "soap scum", "pond scum", "guinea pig", "lab rat"]
PRIOR_WEIGHT, SAMPLE, LEXICON, LEAST_TEXTS, LEAST_ODDS, CONFIDENCE = 1.5, 20_000, 2_000, 5, 4.0, 3.0
#: Letters of a beginning that may stand for all words with it, and by how much it must exceed each of them.
BEGINNING, GAIN = range(4, 11), 1.5
POWERS, THRESHOLD = (0.125, 0.25, 0.5, 1.0), 0.3
#: The curve without labels: power, intercept, slope.
CURVE = (0.25, -3.0, 3.0)
_RUN, _WORD = re.compile(r"[0-9@$!|+€]+"), re.compile(r"[^\W\d_]+")


class Folding(dict):
    """A table for str.translate, filled as characters are met."""

    def __missing__(self, code: int):
        x = chr(code)
        if x.isspace():
            to = " "
        elif unicodedata.category(x) in ("Mn", "Me", "Cf"):
            to = None
        else:
            to = unicodedata.normalize("NFKD", x)[:1].lower()[:1] or x
            to = LOOKALIKES.get(to, to)
            to = "i" if to == "l" else to
        self[code] = to
        return to


_FOLDING = Folding()


def letters_for(m: re.Match, at_end: bool) -> str:
    """A run of digits and symbols with letters where it stands for some."""
    run, (a, b), text = m[0], m.span(), m.string
    before, after = a > 0 and text[a - 1].isalpha(), b < len(text) and text[b].isalpha()
    plain = run.isdigit() or len(run) == 1
    if before and after or after and plain or before and at_end and plain and run != "!":
        return "".join(STANDS_FOR[x] for x in run)
    return run[:-1] + STANDS_FOR[run[-1]] if after else run


def readings(text: str) -> list[str]:
    """The folded text; a second time with runs at the ends of words as letters, where that differs."""
    plain = text.translate(_FOLDING)
    if not _RUN.search(plain):
        return [plain]
    first, second = (_RUN.sub(lambda m, e=e: letters_for(m, e), plain) for e in (False, True))
    return [first] if first == second else [first, second]


def term(text: str) -> str:
    return readings(text)[0]


def automaton(weights: dict[str, float], exceptions: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, weight in weights.items():
        plain = word.rstrip("*")
        if plain not in out or plain == word:
            out.add_word(plain, (len(plain), word, weight))
    for phrase in exceptions:
        out.add_word(phrase, (len(phrase), phrase, None))
    if len(out):
        out.make_automaton()
    return out


def ends_word(text: str, at: int) -> bool:
    """Whether a term that stops before ``at`` is a word or its plural."""
    for suffix in ("", "s", "es"):
        if text.startswith(suffix, at) and not text[at + len(suffix) : at + len(suffix) + 1].isalpha():
            return True
    return False


def places(folded: list[str], machine) -> list[tuple[int, int, str, float]]:
    """Start, stop, term and weight of the places that count, none within another."""
    found, spared = {}, []
    if not len(machine):
        return []
    for text in folded:
        for last, (long, word, weight) in machine.iter(text):
            start = last + 1 - long
            if start and text[start - 1].isalpha() or word[-1] != "*" and not ends_word(text, last + 1):
                continue
            if weight is None:
                spared.append((start, last + 1))
            else:
                found[start, last + 1] = (word, weight)
    out, reach = [], 0
    for (a, b), (word, weight) in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if b > reach and not any(s <= a and b <= e for s, e in spared):
            out.append((a, b, word, weight))
            reach = b
    return out


def figure(found, folded: str, power: float) -> float:
    """Log of one plus the weights' sum, divided by a power of the length."""
    return math.log1p(sum(w for *_, w in found) / max(1.0, (folded.count(" ") + 1) / 100) ** power)


def sketch(words: list[str]) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    if len(words) < 3:
        return zlib.crc32(" ".join(words).encode())
    return min(zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(len(words) - 2))


def decoded(batch) -> list[str]:
    return [x.decode("utf-8", "replace") for x in texts_of(batch)]


def training(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Written: toxic and text of about ``bound`` labelled documents, one for each sketch."""
    known = labels.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, bound / 2 / max(1, sizes.get(1, 0)))).otherwise(min(1.0, bound / 2 / max(1, sizes.get(0, 0))))
    chosen = known.where(place < share)  # about ``bound`` ids and labels, so a broadcast is bounded
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                marks = [sketch(_WORD.findall(readings(x)[0])) for x in decoded(part)]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), part.column(0), part.column(1)], ["mark", "toxic", "text"])

    rows = texts.select("toxic", "text").mapInArrow(lean(run), "mark long, toxic int, text string")
    return written(rows.groupBy("mark").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "toxicity")


def tallied(rows: DataFrame, keys_of) -> DataFrame:
    """key, toxic and clean texts that have it, added up in each task first."""

    def run(batches):
        total = {}
        for whole in batches:
            for part in slices(whole):
                for toxic, text in zip(part.column(0).to_pylist(), decoded(part)):
                    for key in keys_of(text):
                        total.setdefault(key, [0, 0])[0 if toxic else 1] += 1
                if len(total) > 200_000:
                    yield from handed(total)
                    total = {}
        yield from handed(total)

    def handed(total):
        keys = list(total)
        for k in range(0, len(keys) + 1, 8192):
            some = keys[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[x][0] for x in some], pa.int64()), pa.array([total[x][1] for x in some], pa.int64())], ["key", "t", "c"])

    return rows.select("toxic", "text").mapInArrow(lean(run), "key string, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def weight_of(t: float, c: float, odds: float) -> float:
    """Log odds by which a key in ``t`` toxic and ``c`` clean texts speaks for toxic, at Wilson's lower bound of its toxic share."""
    z, n = CONFIDENCE, t + c
    p = t / n
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return math.log(max(low, 1e-9) / (1 - low)) - odds


def words_and_beginnings(text: str) -> set[str]:
    words = set(_WORD.findall(readings(text)[0]))
    return words | {w[:k] + "*" for w in words for k in BEGINNING if k < len(w)}


def lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of terms; those that end in * stand for all words that begin so."""
    out = {term(x): PRIOR_WEIGHT for x in SEEDS}
    if not n_toxic or not n_clean:
        return out
    odds = math.log(n_toxic / n_clean)
    counts = tallied(rows, words_and_beginnings)
    often = (F.col("t") >= LEAST_TEXTS) & (F.col("t") * n_clean > F.col("c") * n_toxic * LEAST_ODDS) & (F.length("key") >= 3)
    found = {r.key: (r.t, r.c) for r in counts.where(often).orderBy(F.desc(F.col("t") * n_clean - F.col("c") * n_toxic), "key").limit(LEXICON * 4).collect()}
    good = {k: w for k, (t, c) in found.items() if (w := weight_of(t, c, odds)) >= math.log(LEAST_ODDS)}
    single: dict[str, int] = {}  # for each beginning the most texts that one word with it has
    for k in good:
        if k[-1] != "*":
            for n in BEGINNING:
                single[k[:n]] = max(single.get(k[:n], 0), found[k][0])
    kept: dict[str, float] = {}
    for k in sorted(good, key=lambda k: (len(k), k)):
        above = max((kept.get(k[:n] + "*", 0.0) for n in BEGINNING if n < len(k)), default=0.0)
        if good[k] > above and (k[-1] != "*" or found[k][0] >= GAIN * single.get(k[:-1], 1)):
            kept[k] = good[k]
    for r in counts.where(F.col("key").isin(list(out))).collect():
        if r.t + r.c >= LEAST_TEXTS:
            out.pop(r.key)  # what was learned replaces the prior weight
    return out | dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def around(text: str, machine) -> set[str]:
    """Each counted term with the word before and the word after it."""
    folded = readings(text)
    out = set()
    for a, b, *_ in places(folded, machine):
        before = re.search(r"[^\W\d_]+ $", folded[0][max(0, a - 60) : a])
        after = re.match(r"[^\W\d_]* [^\W\d_]+", folded[0][b : b + 60])
        out |= {before[0] + folded[0][a:b]} if before else set()
        out |= {folded[0][a:b] + after[0]} if after else set()
    return out


def curve(rows: DataFrame, machine) -> tuple[float, float, float]:
    """The power of the length, intercept and slope that make the labels likeliest, from counts of rounded figures."""

    def run(batches):
        total = Counter()
        for whole in batches:
            for part in slices(whole):
                for toxic, text in zip(part.column(0).to_pylist(), decoded(part)):
                    folded = readings(text)
                    found = places(folded, machine)
                    total.update((p, round(figure(found, folded[0], p), 2), toxic) for p in POWERS)
        columns = list(zip(*((*k, n) for k, n in total.items()))) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.float64(), pa.float64(), pa.int32(), pa.int64()))], ["power", "x", "toxic", "n"])

    bins = rows.select("toxic", "text").mapInArrow(lean(run), "power double, x double, toxic int, n long").groupBy("power", "x", "toxic").agg(F.sum("n").alias("n"))
    found = bins.toPandas()
    best = None
    for power in POWERS:
        d = found[found["power"] == power]
        a, b, loss = logistic(d["x"].to_numpy(), d["toxic"].to_numpy(float), d["n"].to_numpy(float))
        if best is None or loss < best[0]:
            best = (loss, power, a, b)
    return best[1:]


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Intercept, slope and penalised loss of a logistic curve by Newton's steps."""
    w, design, ridge = np.zeros(2), np.column_stack((np.ones(len(x)), x)), np.diag([1e-6, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (n * (y - p)) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
    return float(w[0]), float(w[1]), float(-(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + w @ ridge @ w / 2)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Weights of terms, exception phrases and the curve."""
    ship(docs.sparkSession)
    rows = training(docs, labels, bound)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    weights = lexicon(rows, n_toxic, n_clean)
    exceptions = [term(x) for x in EXCEPTIONS]
    if n_toxic and n_clean:
        machine, share = automaton(weights, exceptions), n_toxic / (n_toxic + n_clean)
        mild = tallied(rows, lambda text: around(text, machine)).where((F.col("c") >= LEAST_TEXTS) & (F.col("t") <= share * (F.col("t") + F.col("c"))))
        exceptions += [r.key for r in mild.orderBy(F.desc("c"), "key").limit(LEXICON).collect()]
    # Both classes were sampled alike, so the curve is fitted to their true shares again.
    rates = rate(labels)
    power, a, b = curve(rows, automaton(weights, exceptions)) if n_toxic and n_clean else CURVE
    if n_toxic and n_clean and 0 < rates < 1:
        a += math.log(rates / (1 - rates)) - math.log(n_toxic / n_clean)
    discard(rows)
    return {"weights": weights, "exceptions": exceptions, "power": power, "intercept": a, "slope": b}


def rate(labels: DataFrame) -> float:
    """Share of toxic ones among all labels that may be learned from."""
    known = labels.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted, and the places that count: start and stop in the text (code points), term, weight."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    hit = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("term", pa.string()), ("weight", pa.float64())])

    def run(batches):
        m = shared.value
        machine = automaton(m["weights"], m["exceptions"])
        for whole in batches:
            for part in slices(whole):
                scores, hits = [], []
                for text in decoded(part):
                    folded = readings(text)
                    found = places(folded, machine)
                    if found and len(folded[0]) != len(text):  # invisible characters are gone
                        at = [k for k, x in enumerate(text) if _FOLDING[ord(x)] is not None]
                        own = [(at[a], at[b - 1] + 1, w, v) for a, b, w, v in found]
                    else:
                        own = found
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m["intercept"] + m["slope"] * figure(found, folded[0], m["power"]))))))
                    hits.append([dict(zip(("start", "stop", "term", "weight"), x)) for x in own])
                called = [int(s >= THRESHOLD) for s in scores]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(called, pa.int32()), pa.array(hits, pa.list_(hit))], ["doc_id", "score", "predicted", "hits"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int, hits array<struct<start: long, stop: long, term: string, weight: double>>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted", F.size("hits").alias("n_hits"))
