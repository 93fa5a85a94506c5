"""Arrays by name in .npz files: a source that reads one file or a folder of them, and a sink that writes a folder.

Reading makes one partition of each file; writing, one file of each partition.
A task writes under a name of its own, and only files of tasks that succeeded
get their final names, when all have.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from attestor.session import ship

SCHEMA = "name string, dtype string, shape array<long>, values array<double>"


def located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.only = options["path"], options.get("name")

    def partitions(self):
        from pyarrow import fs

        files, at = located(self.path)
        if files.get_file_info(at).type == fs.FileType.File:
            return [File(at)]
        found = files.get_file_info(fs.FileSelector(at))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".npz")] or [File("")]

    def read(self, part):
        if not part.path:
            return
        files, _ = located(self.path)
        with files.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            for member in z.namelist():
                name = member.removesuffix(".npy")
                if self.only is None or name == self.only:
                    x = np.lib.format.read_array(io.BytesIO(z.read(member)), allow_pickle=False)
                    yield name, x.dtype.str, list(x.shape), x.astype(float).ravel().tolist()


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows):
        from pyspark import TaskContext

        files, at = located(self.path)
        files.create_dir(at)
        part = TaskContext.get().partitionId()
        temporary, n = f"{at}/.{self.run}-{part}-{uuid.uuid4().hex}.partial", 0
        with files.open_output_stream(temporary) as f, zipfile.ZipFile(f, "w") as z:
            for r in rows:
                x = np.array(r.values, float).reshape(r.shape).astype(r.dtype or "<f8")
                body = io.BytesIO()
                np.lib.format.write_array(body, x, allow_pickle=False)
                z.writestr(f"{r.name}.npy", body.getvalue())
                n += 1
        if not n:
            files.delete_file(temporary)
            return Written(None, None)
        return Written(temporary, f"{at}/part-{part:05d}-{self.run}.npz")

    def commit(self, messages):
        from pyarrow import fs

        files, at = located(self.path)
        files.create_dir(at)
        old = [f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npz")] if self.overwrite else []
        for m in messages:
            if m is not None and m.temporary:
                files.move(m.temporary, m.final)
        for path in old:
            files.delete_file(path)

    def abort(self, messages):
        files, _ = located(self.path)
        for m in messages:
            if m is not None and m.temporary:
                files.delete_file(m.temporary)


class Npz(DataSource):
    """Source and sink ``npz``: option path (a URI), and for reading one array, name."""

    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def read_npz(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """name, dtype, shape and values (row by row) of the arrays of a file or folder, or of the one so named."""
    ship(spark)
    spark.dataSource.register(Npz)
    r = spark.read.format("npz").option("path", path)
    return (r if name is None else r.option("name", name)).load()


def write_npz(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows of name, dtype, shape and values; names must be distinct within a partition."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(Npz)
    df.select("name", "dtype", "shape", "values").write.format("npz").option("path", path).mode(mode).save()
