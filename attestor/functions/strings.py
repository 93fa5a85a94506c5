"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.numeric import col, jaccard

BLANKS = " \t\n\r\x0b\x0c"


def strip(c) -> Column:
    """Remove all ASCII white space at both ends; trim() alone removes only spaces."""
    return F.btrim(col(c), F.lit(BLANKS))


def norm_words(c) -> Column:
    """Lower-case ASCII words; anything but letters, digits and spaces parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]+", " "), r"\s+"), lambda w: w != "")


def contains_phrase(text, phrase) -> Column:
    """Whether the words of phrase stand together in text; an empty phrase is in every text."""
    inner = F.array_join(norm_words(phrase), " ")
    return (inner == "") | F.contains(F.concat(F.lit(" "), F.array_join(norm_words(text), " "), F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))


def token_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def lexical_jaccard(a, b) -> Column:
    return jaccard(token_set(a), token_set(b))


def ngrams(words, longest: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct spans of 1 to ``longest`` words, sorted, without spans of stop words alone."""
    words = col(words)

    def of(n):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        spans = F.transform(starts, lambda i: F.slice(words, i + 1, n))
        if stop:
            spans = F.filter(spans, lambda s: F.exists(s, lambda w: ~w.isin(*stop)))
        return F.transform(spans, lambda s: F.array_join(s, " "))

    return F.array_sort(F.array_distinct(F.concat(*[of(n) for n in range(1, longest + 1)])))


def delete_words(words, start, stop) -> Column:
    """The words without those from start up to stop (counted from 0), as text."""
    words, start, stop = col(words), col(start), col(stop)
    rest = F.greatest(F.size(words) - stop, F.lit(0))
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(words, stop + 1, rest)), " ")


#: Nouns that stand for annotation types, in order of precedence of the types given.
GENERIC = {"people": "person", "animals": "animal", "vehicles": "vehicle", "instruments": "object", "clothing": "clothing", "bodyparts": "body part", "scene": "scene", "other": "thing"}
#: Words that may open a generalised phrase.
LEADS = ["a", "an", "the", "one", "two", "three", "four", "five", "six", "several", "many"]


def generalise(phrase, types) -> Column:
    """A phrase of as many words that names only the type."""
    nouns = F.create_map(*[F.lit(x) for kv in GENERIC.items() for x in kv])
    known = F.filter(col(types), lambda t: t.isin(*GENERIC))
    noun = F.split(F.coalesce(F.element_at(nouns, F.get(known, F.lit(0))), F.lit("thing")), " ")
    words = F.split(strip(phrase), r"\s+")
    n = F.size(words)
    last = F.element_at(noun, -1)
    one = F.when(F.lower(last) == F.lower(words[0]), "entity").otherwise(last)
    lead = F.when(F.lower(words[0]).isin(*LEADS), words[0]).otherwise("unspecified")
    fill = F.array_repeat(F.lit("unspecified"), F.greatest(n - F.size(noun) - 1, F.lit(0)))
    whole = F.concat(F.array(lead), fill, noun)
    cut = F.slice(whole, F.lit(1), n)
    other = F.slice(F.concat(F.slice(whole, F.lit(1), F.size(whole) - 1), F.array(F.lit("entity"))), F.lit(1), n)
    text = F.array_join(cut, " ")
    return F.when(n == 1, one).when(contains_phrase(text, phrase), F.array_join(other, " ")).otherwise(text)


def label(c, allowed: list[str], alias: dict[str, str] | None = None) -> Column:
    """Normalise a model's label: trimmed, upper case, without . : - at the ends, spaces to underscores; null unless allowed."""
    x = F.replace(F.btrim(F.upper(strip(c)), F.lit(".:-")), F.lit(" "), F.lit("_"))
    for old, new in (alias or {}).items():
        x = F.when(x == old, new).otherwise(x)
    return F.when(x.isin(*allowed), x)


def only_label(c, allowed: list[str]) -> Column:
    """The one label that the text names as a word; null if none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(col(c)), F.lit(r"\b(" + "|".join(allowed) + r")\b"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def recovered_label(c, allowed: list[str], alias: dict[str, str] | None = None) -> Column:
    """The label that the text is, or else the only one that it names."""
    return F.coalesce(label(c, allowed, alias), only_label(c, allowed))


def binary_label(c, allowed: list[str], codes: dict[str, str]) -> Column:
    """A lower-case label or its code, stripped of marks at the ends, or else the only label named."""
    x = F.btrim(F.lower(strip(c)), F.lit(" .,:;!*-_"))
    m = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b(" + "|".join(allowed) + r")\b"), F.lit(1)))
    return F.when(x.isin(*codes), F.element_at(m, x)).when(x.isin(*allowed), x).when(F.size(found) == 1, F.get(found, F.lit(0)))


def coded_label(c, codes: dict[str, str]) -> Column:
    """The label that the first letter stands for."""
    m = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.element_at(m, F.upper(F.substring(strip(c), 1, 1)))


def choice(c, n, stop_index, stop: str = "STOP") -> Column:
    """The number at the end of an answer if it is from 0 to n - 1; the stop index for the stop word; else -1."""
    x = F.try_to_number(F.nullif(F.regexp_extract(strip(c), r"(?i)(?:CHOICE\s*=\s*)?(\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return F.when(x.between(0, col(n) - 1), x).when(F.upper(strip(c)) == stop, F.coalesce(col(stop_index), F.lit(-1))).otherwise(-1).cast("int")


def word_count(c) -> Column:
    return F.size(F.filter(F.split(strip(c), r"\s+"), lambda w: w != ""))


def same_text(a, b) -> Column:
    """Equality up to case and white space."""
    def plain(x):
        return F.lower(F.regexp_replace(strip(x), r"\s+", " "))

    return plain(a) == plain(b)


def joined_query(captions) -> Column:
    """Captions, sorted, without closing full stops, joined by ' . '."""
    return F.concat(F.array_join(F.transform(F.array_sort(col(captions)), lambda x: F.rtrim(F.regexp_replace(F.btrim(x, F.lit(BLANKS)), r"[.\s]+$", ""))), " . "), F.lit(" ."))


def stem(c) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_extract(col(c), r"([^/]+?)(?:\.[^./]*)?$", 1)


def span_valid(start, stop, text) -> Column:
    return (col(start) >= 0) & (col(start) < col(stop)) & (col(stop) <= F.length(col(text)))


def is_sentinel(c, sentinels: list[str], exact: bool = False) -> Column:
    """Whether a text is one of the agreed words for 'nothing'; some stages compare exactly, others after trimming and upper-casing."""
    return (col(c) if exact else F.upper(strip(c))).isin(*sentinels)


def fenced_json(c, keys: list[str]) -> Column:
    """The object in a text, code fences removed: a map if it has exactly ``keys``, all with text; else null."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    m = F.from_json(bare, "map<string,string>")
    right = (F.size(F.map_keys(m)) == len(keys)) & (F.size(F.array_except(F.map_keys(m), F.lit(keys))) == 0)
    return F.when(right & F.forall(F.map_values(m), lambda v: F.coalesce(F.length(F.btrim(v, F.lit(BLANKS))) > 0, F.lit(False))), m)


def with_prior(text, prior, lead: str) -> Column:
    """Append a prior text, introduced by ``lead``, if there is one."""
    return F.concat(col(text), F.coalesce(F.concat(F.lit(lead), col(prior)), F.lit("")))


def parse_inline(line) -> Column:
    """Struct of plain text and phrases from a line with [/EN#id/type words] annotations.

    phrases: array of id, types, phrase, start and stop in words of the plain text.
    """
    line = col(line)
    pieces = F.regexp_extract_all(line, F.lit(r"(\[/EN#[^ ]+ [^\]]+\]|[^\[]+)"), F.lit(1))

    def step(acc, piece):
        tagged = piece.startswith("[/EN#")
        meta = F.split(F.regexp_extract(piece, r"^\[(/EN#[^ ]+) ", 1), "/")
        phrase = F.regexp_extract(piece, r"^\[/EN#[^ ]+ ([^\]]+)\]$", 1)
        words = F.filter(F.split(F.when(tagged, phrase).otherwise(piece), r"\s+"), lambda w: w != "")
        start = F.size(acc["words"])
        found = F.struct(
            F.regexp_replace(F.get(meta, F.lit(1)), "^EN#", "").alias("id"),
            F.slice(meta, 3, 99).alias("types"),
            phrase.alias("phrase"),
            start.alias("start"),
            (start + F.size(words)).alias("stop"),
        )
        return F.struct(
            F.concat(acc["words"], words).alias("words"),
            F.when(tagged, F.concat(acc["phrases"], F.array(found))).otherwise(acc["phrases"]).alias("phrases"),
        )

    empty = F.expr("named_struct('words', cast(array() as array<string>), 'phrases', cast(array() as array<struct<id:string,types:array<string>,phrase:string,start:int,stop:int>>))")
    return F.aggregate(pieces, empty, step, lambda a: F.struct(F.array_join(a["words"], " ").alias("text"), a["phrases"].alias("phrases")))
