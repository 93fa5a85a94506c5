"""Line-first cleaning with built-in expressions only.

Each line is judged on its own by three rules (punctuation, navigation,
boilerplate), failing lines are removed, and a document that loses too much of
its text, or that fails the base rules, is rejected.

Defined results for odd inputs: null and empty texts have no words and are
rejected; a repeated row is judged like any other, once per copy; empty tables
give empty results; columns other than ``doc_id`` and ``text`` pass through
:func:`clean` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, let, words

SYMBOLS = "#*$%&|<>"
#: Marks that pile up in symbol spam and shouting, but seldom in prose.
MARKS = "#*$%&|<>!?~^={}[]\\"
HAS_WORD = r"[^\x20\x09-\x0D]"
TERMINAL = ".!?:;…。！？”\"'»)]"
BLANKS = " \t\n\x0b\f\r"
BOILERPLATE = (
    r"(?i)lorem ipsum|enable javascript|javascript is (?:disabled|required)|accept (?:all )?cookies|"
    r"uses cookies|cookie policy|privacy policy|terms of (?:use|service)|click here to|subscribe to our newsletter|"
    r"skip to (?:main )?content|back to top"
)
SEPARATORS = "|»›·•"


def among(text: Column, characters: str) -> Column:
    """How many characters of a text are among these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, stock: Column, min_words: int = 4) -> Column:
    """True for a line that one of the three rules removes; blank lines stay.

    punctuation: four or more marks, at least one for every two words; or fewer
    than ``min_words`` words without a closing mark.
    navigation: three or more separators, at least one for every three words.
    boilerplate: a stock phrase of web pages; ``stock`` tells whether the text has any.

    Words are counted only where the cheaper part of a rule holds.
    """
    n_words = F.size(words(line))
    marks, separators = among(line, MARKS), among(line, SEPARATORS)
    closed = F.contains(F.lit(TERMINAL), F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1)))
    return line.rlike(HAS_WORD) & (
        ((marks >= 4) & (marks * 2 >= n_words))
        | (~closed & (n_words < min_words))
        | ((separators >= 3) & (separators * 3 >= n_words))
        | (stock & line.rlike(BOILERPLATE))
    )


def repeated_words(word_array: Column, width: int = 3) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more.

    Windows are compared by a 64-bit hash; sorting (hash, position) brings
    equal windows together, so the cost is n log n for any text.
    """

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s, lambda x, k: F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def count(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, starts), count))

    return F.when(F.size(word_array) <= width, 0).otherwise(let(word_array, lambda w: let(windows(w), covered)))


def assess(docs: DataFrame, min_words: int = 50, max_repeat: float = 0.5, max_loss: float = 0.3) -> DataFrame:
    """One row per document: figures, verdict and the cleaned text.

    ``lost_chars`` counts the word characters of removed lines; a document is
    kept if it passes the base rules and loses no more than ``max_loss``.  Lines
    are judged only where the base rules pass; elsewhere it is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", words(F.col("text")).alias("w"))
    d = d.select(
        "doc_id",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat)
    d = d.select("*", base_failed.alias("base_failed"), F.split("text", "\n").alias("lines"))
    full = F.filter("lines", lambda x: x.rlike(HAS_WORD))

    def good(stock: Column) -> Column:
        return F.array_join(F.filter("lines", lambda x: ~line_fails(x, stock)), "\n")

    d = d.select(
        "doc_id",
        "n_words",
        "word_chars",
        among(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        F.when(~F.col("base_failed"), let(F.col("text").rlike(BOILERPLATE), good)).alias("clean_text"),
    )
    good_chars = F.length(F.array_join(words(F.col("clean_text")), ""))
    d = d.withColumn("lost_chars", F.when(~F.col("base_failed"), F.col("word_chars") - good_chars).cast("long"))
    return d.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.col("lost_chars") <= F.col("word_chars") * max_loss))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: rejected documents go, failing lines of the others go.

    Judged in place, without a join, so that repeated ids do no harm.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    # a generator keeps the verdict from being evaluated once as a filter and once more as a result
    verdict = F.inline_outer(F.array(F.struct("kept", "clean_text")))
    d = assess(docs.select(row.alias("doc_id"), F.col("text"))).select("doc_id", verdict).where("kept")
    put = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return d.select(*[put[c].alias(c) if c in put else F.col("doc_id").getField(c).alias(c) for c in names])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


#: The same figures and verdict in DuckDB's SQL, line by line and window by window.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS lines FROM d),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, word AS a, lead(word) OVER s AS b, lead(word, 2) OVER s AS c FROM k WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM t),
f AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
      len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words,
      length(regexp_replace(line, '[^#*$%&|<>!?~^={}\[\]\\]', '', 'g')) AS marks,
      length(regexp_replace(line, '[^|»›·•]', '', 'g')) AS separators,
      regexp_matches(line, '[.!?:;…。！？”"''»)\]][\x20\x09-\x0D]*\z') AS closed,
      regexp_matches(line, '(?i)lorem ipsum|enable javascript|javascript is (?:disabled|required)|accept (?:all )?cookies|uses cookies|cookie policy|privacy policy|terms of (?:use|service)|click here to|subscribe to our newsletter|skip to (?:main )?content|back to top') AS stock FROM l),
n AS (SELECT doc_id, count(*) FILTER (WHERE n_words > 0) - count(DISTINCT line) FILTER (WHERE n_words > 0) AS n_dup_lines,
      coalesce(sum(chars) FILTER (WHERE n_words > 0 AND ((marks >= 4 AND marks * 2 >= n_words) OR (n_words < 4 AND NOT closed) OR (separators >= 3 AND separators * 3 >= n_words) OR stock)), 0) AS lost FROM f GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, lost FROM t JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND lost <= word_chars * CAST(0.3 AS DOUBLE) AS kept, CASE WHEN NOT base_failed THEN CAST(lost AS BIGINT) END AS lost_chars FROM v"""
