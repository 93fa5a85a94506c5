"""Sources and sinks under explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.numeric import col


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, within the file) and raw text of the non-blank lines of a JSONL file or folder.

    Rows of a block of a file are read in order by one task, so a row's number
    within its block is its distance from the block's first; the lines of the
    blocks before are summed over a table of one row a block.
    """
    at, block, row = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("value").alias("raw"), at.alias("file"), block.alias("block"), row.alias("row"))
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = lines.join(blocks, ["file", "block"]).select("raw", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line"), "file")
    return numbered.where(F.btrim(F.col("raw"), F.lit(" \t\r\n\x0b\x0c")) != "")


def record_problem(raw: Column, required: list[str], optional: list[str]) -> Column:
    """What is wrong with a record's form: not JSON, not an object, keys missing or unknown; else null."""
    m = F.from_json(raw, "map<string,string>")
    keys = F.map_keys(m)
    missing = F.array_sort(F.array_except(F.lit(required), keys))
    extra = F.array_sort(F.array_except(keys, F.lit([*required, *optional])))
    array = F.ltrim(raw).startswith("[")
    bad = F.size(missing) + F.size(extra) > 0
    return (
        F.when(array, "record must be an object")
        .when(F.try_parse_json(raw).isNull(), "invalid JSON")
        .when(m.isNull() | ~F.ltrim(raw).startswith("{"), "record must be an object")
        .when(bad, F.concat(F.lit("missing="), F.to_json(missing), F.lit(", extra="), F.to_json(extra)))
    )


def strict_jsonl(spark: SparkSession, path: str, schema: str, optional: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with _source_line, problems (line, problem, file)) of a JSONL table with exactly the schema's keys.

    A value of the wrong type is a problem too: true is no number, 1.5 no whole
    number, and an array of objects on a line is not taken apart.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    lines = raw_lines(spark, path).withColumn("form", record_problem(F.col("raw"), [n for n in names if n not in optional], list(optional)))
    parsed = lines.withColumn("row", F.from_json("raw", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    problem = F.coalesce(F.col("form"), F.when(F.col("row._corrupt").isNotNull(), "value of the wrong type"))
    problems = parsed.where(problem.isNotNull()).select("line", problem.alias("problem"), "file")
    rows = parsed.where(F.col("form").isNull()).select(*[F.col(f"row.`{n}`").alias(n) for n in names], F.col("line").alias("_source_line"))
    return rows, problems


def clean(df: DataFrame) -> DataFrame:
    """Without the line number."""
    return df.drop("_source_line")


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; none if there is no file."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; bad rows and a missing file raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one JSON document, an object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table, all strings, with quoted line breaks; a byte-order mark does no harm; empty fields are ''."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.removeprefix("﻿") for c in d.columns]
    return d.toDF(*names).na.fill("")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*[F.col(f).cast("string").alias(f) for f in fields]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """JSONL with keys in sorted order; the committer swaps the result in only when it is whole."""
    d = clean(df)
    d = d.select(*sorted(d.columns))
    (d.orderBy(*order_by) if order_by else d).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One row (id) for each word of a text file."""
    return spark.read.text(path).select(F.explode(F.split(F.btrim("value", F.lit(" \t\r\n")), r"\s+")).alias("id")).where("id <> ''")


def write_arrays(df: DataFrame, path: str) -> None:
    """Named arrays (name string, value array<...>) as Parquet, the columnar store for vectors."""
    df.write.mode("overwrite").parquet(path)


def read_array(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("name") == name).select("value")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated box from XML files: file, width, height, name, xmin, ymin, xmax, ymax."""
    schema = (
        "size struct<width:int,height:int>, object array<struct<name:array<string>,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"
    )
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_xml("value", schema).alias("x"))
    o = x.select("file", "x.size.*", F.explode("x.object").alias("o")).where("o.bndbox IS NOT NULL")
    return o.select("file", "width", "height", F.explode("o.name").alias("name"), "o.bndbox.*")


def boxes_by_name(objects: DataFrame, least: int = 1) -> DataFrame:
    """file, name, boxes (half-open, within the image) of at least ``least`` pixels each way."""
    from attestor.functions.geometry import from_one_based

    d = objects.withColumn("box", from_one_based("xmin", "ymin", "xmax", "ymax", "width", "height"))
    d = d.where((F.col("box")[2] - F.col("box")[0] >= least) & (F.col("box")[3] - F.col("box")[1] >= least))
    return d.groupBy("file", "name").agg(F.array_sort(F.collect_list("box")).alias("boxes"))


def ledger(df: DataFrame, line: str = "value") -> DataFrame:
    """Jobs from a scheduler's pipe-delimited listing; steps (a dot in the id) and blank lines go."""
    p = F.split(F.col(line), r"\|")
    tres = F.filter(F.split(F.get(p, F.lit(4)), ","), lambda x: F.contains(x, F.lit("=")))
    m = F.str_to_map(F.array_join(tres, ","), F.lit(","), F.lit("="))
    d = df.where((F.btrim(F.col(line)) != "") & ~F.contains(F.get(p, F.lit(0)), F.lit("."))).select(
        F.get(p, F.lit(0)).alias("job_id"), F.get(p, F.lit(1)).alias("partition"), F.coalesce(F.try_to_number(F.nullif(F.get(p, F.lit(2)), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0).cast("long")).alias("elapsed_seconds"), F.get(p, F.lit(3)).alias("state"), m.alias("tres")
    )
    return d.withColumn("allocated_gpus", gpus("tres")).withColumn("gpu_hours", F.col("allocated_gpus") * F.col("elapsed_seconds") / 3600.0)


def gpus(tres) -> Column:
    """The untyped resource if it is given, else the sum of the typed ones."""
    typed = F.map_filter(col(tres), lambda k, v: k.startswith("gres/gpu:"))
    total = F.aggregate(F.map_values(typed), F.lit(0), lambda a, x: a + x.cast("int"))
    return F.coalesce(F.try_element_at(col(tres), F.lit("gres/gpu")).cast("int"), total)


def utilisation(df: DataFrame, line: str = "value") -> DataFrame:
    """Samples, mean, maximum and share above zero of the percentages in a monitor's log."""
    x = F.try_to_number(F.nullif(F.regexp_extract(F.col(line), r" (\d+) %,", 1), F.lit("")), F.lit("999")).cast("int")
    d = df.select(x.alias("x")).where("x IS NOT NULL")
    return d.agg(F.count("*").alias("samples"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.avg((F.col("x") > 0).cast("int")).alias("nonzero"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def is_missing(error: Exception) -> bool:
    return isinstance(error, AnalysisException) and "PATH_NOT_FOUND" in str(error)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON document: an array of rows, keys in sorted order, in the order of the rows."""
    names = sorted(report.columns)
    d = report.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"))
    d = d.agg(F.to_json(F.array_sort(F.collect_list("r")), {"ignoreNullFields": "false"}).alias("value"))
    d.coalesce(1).write.mode("overwrite").text(path)


def markdown(report: DataFrame, title: str, order: list[str]) -> DataFrame:
    """A report as one text (column value): a heading and a table; null cells are empty, bars in cells are escaped."""
    names = report.columns
    cells = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in names]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = report.select(F.struct(*[F.col(c) for c in order], line.alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")
    head = f"# {title}\n\n| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
    return rows.agg(F.concat(F.lit(head), body, F.lit("\n")).alias("value"))


def write_markdown(report: DataFrame, path: str, title: str, order: list[str]) -> None:
    markdown(report, title, order).coalesce(1).write.mode("overwrite").text(path)
