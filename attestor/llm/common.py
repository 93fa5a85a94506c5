"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import removed, scratch, ship  # noqa: F401

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Inside a higher-order function a plain column reference may be inlined by
    the optimizer and then evaluated for each element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Folders written so far and not yet deleted, and the table of each that has one; a run has a list of its own.
_MADE: dict[str, str | None] = {}
_RUN: ContextVar[dict[str, str | None] | None] = ContextVar("attestor_run", default=None)


def _made() -> dict[str, str | None]:
    run = _RUN.get()
    return _MADE if run is None else run


def place(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new path in the application's folder, which clear() deletes, or the run it belongs to."""
    path = scratch(spark, name)
    _made()[path] = table
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestor_path = path
    return out


def _deleted(spark: SparkSession, made: dict[str, str | None], path: str) -> None:
    table = made.pop(path, None)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    removed(spark, path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of written frames on which nothing that is still to run depends."""
    for df in frames:
        if path := getattr(df, "_attestor_path", None):
            _deleted(df.sparkSession, _made(), path)


@contextmanager
def own_run(spark: SparkSession):
    """What is written inside belongs to this run alone and is deleted at its end, but for frames given to keep().

    Other threads, and other runs, have lists of their own.
    """
    mine: dict[str, str | None] = {}
    before = _RUN.set(mine)
    kept: list[DataFrame] = []
    try:
        yield kept.append
    finally:
        _RUN.reset(before)
        for df in kept:
            path = getattr(df, "_attestor_path", None)
            if path in mine:
                _made()[path] = mine.pop(path)
        for path in list(mine):
            _deleted(spark, mine, path)


def clear(spark: SparkSession) -> None:
    """Delete the folders and tables that operators have written outside of runs.

    Results are lazy: call this when they have been stored elsewhere.  Whatever
    is left goes with the application.
    """
    for path in list(_MADE):
        _deleted(spark, _MADE, path)


def partitions(df: DataFrame, mb: int = 64, most: int = 1 << 20) -> int:
    """Partitions for a shuffle of ``df``: as many as the session sets, more where its estimated size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # what is no file has no estimate
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((known >> 20) // mb, most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(batch) -> list[bytes]:
    """UTF-8 bytes of a batch's text column; null counts as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index("text"))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def slices(batch, most: int = 6 << 20):
    """Parts of an Arrow batch that hold about ``most`` bytes of text each, or one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    text = batch.column(batch.schema.get_field_index("text"))
    sizes = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def distinct_words(text):
    """Words between ASCII white space of an Arrow string array, numbered.

    Returns the distinct words as bytes, the number of each word in order, and
    the number of words of each text.  Null counts as empty.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.string()), ""))
    coded = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    number = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if b"" in known:  # before leading and after trailing white space
        keep = number != known.index(b"")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        number = number[keep]
    return known, number, sizes


def gathered(flat, starts, sizes, number):
    """Concatenate the slices flat[starts[k] : starts[k] + sizes[k]] for k in number, and their lengths."""
    import numpy as np

    long = sizes[number]
    stops = np.cumsum(long)
    at = np.repeat(starts[number] - (stops - long), long) + np.arange(stops[-1] if len(stops) else 0)
    return flat[at], long


def give_back() -> None:
    """Return freed memory to the system: Python workers stay, idle, beside the executor's JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """``run``, a function of an iterator of batches, giving back memory at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
