"""Corpus pipeline: five operators of attestor.llm, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's result to
the shared folder and reads it back as the next one's input; it writes the last
one too, deletes all that the stages wrote on the way, and returns a table that
needs nothing else.

1. quality rules: documents that they reject go, failing lines of others go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. suffix-array dedup: passages that repeat go;
4. PII: validated values become pseudonyms;
5. packing: the pieces of the documents, with their texts, in batches.

Defined results: a null text, and one without enough words, is rejected by
stage 1; rows with null ids pass like others; equal rows become one in stage 2;
a text of any length is treated whole; columns of any name, also those that an
operator uses itself, pass to the end of stage 4 and null values in them stay;
an empty table gives an empty one from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import neardup, packing, pii, quality, suffixes
from attestor.llm.common import discard, documents, own_run, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, without their failing lines; null, empty and short texts go."""
    return quality.clean(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id (of equal rows, one); texts without a word stand alone."""
    return neardup.stage(spark, docs, sf_dir)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without bytes that repeat; a text may become empty."""
    return suffixes.stage(spark, docs, sf_dir)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms for personal data; null texts stay null."""
    return pii.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most packing.MAX_LEN words; a null or empty text makes one piece of no words."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("pii_pseudonyms", pseudonyms),
    ("packing", packed),
]

#: Chosen paths, suffix merging and keyed permutations have no form in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; what this run has written goes with its end, and nothing else does."""
    with own_run(spark) as keep:
        docs = documents(spark, sf_dir)
        for name, stage in STAGES:
            before, docs = docs, written(stage(spark, docs, sf_dir), name)
            discard(before)
        keep(docs)
    return docs
