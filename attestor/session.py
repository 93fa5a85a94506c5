"""Session defaults for local runs (a cluster sets its own) and the folder for tables on the way."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("attestor")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder and any other one
    an error: executors elsewhere could not see a folder of this machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which is deleted when its JVM ends."""
    sc, path = spark.sparkContext, f"{shared_dir(spark)}/attestor-{spark.sparkContext.applicationId}"
    known = sc.__dict__.setdefault("_attestor_dirs", set())
    if path not in known:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        known.add(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table on the way."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` for the rest of the application and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_attestor_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="attestor-zip-")) / "attestor_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(at))
    sc._attestor_shipped = True
