"""Arrays in .npz files against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.sources import npz


def test_reads_what_numpy_writes(spark, tmp_path):
    arrays = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b/c": np.array([[1], [2]], np.int64), "empty": np.zeros((0, 4)), "one": np.array(3.5)}
    np.savez(tmp_path / "x.npz", **arrays)
    found = {r.name: np.array(r["values"]).reshape(r.shape).astype(r.dtype) for r in npz.read_npz(spark, f"file://{tmp_path}/x.npz").collect()}
    assert set(found) == set(arrays) and all(np.array_equal(found[k], x) and found[k].dtype == x.dtype for k, x in arrays.items())
    assert [r.name for r in npz.read_npz(spark, f"file://{tmp_path}/x.npz", "a").collect()] == ["a"]


def test_numpy_reads_what_is_written(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(f"k{i}", "<f4", [2, 2], [float(i), 1.0, 2.0, 3.0]) for i in range(10)]
    df = spark.createDataFrame(rows, npz.SCHEMA).repartition(3)
    npz.write_npz(df, path)
    found = {}
    for f in (tmp_path / "out").glob("*.npz"):
        with np.load(f) as z:
            found |= {k: z[k] for k in z.files}
    assert len(found) == 10 and all(np.array_equal(found[n], np.array(v).reshape(2, 2)) and found[n].dtype == np.float32 for n, _, _, v in rows)
    npz.write_npz(df.limit(2).coalesce(1), path)  # replaces
    assert npz.read_npz(spark, path).count() == 2
    npz.write_npz(df.where("name = 'k9'"), path, "append")
    assert npz.read_npz(spark, path).count() == 3 and not list((tmp_path / "out").glob(".*partial"))
    assert npz.read_npz(spark, f"file://{tmp_path}").count() == 0


def test_a_failed_write_leaves_the_old(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [("a", "<f8", [1], [1.0])]
    npz.write_npz(spark.createDataFrame(rows, npz.SCHEMA), path)
    bad = spark.createDataFrame(rows + [("b", "<f8", [3], [1.0])], npz.SCHEMA).repartition(2, F.col("name"))
    with pytest.raises(Exception, match="reshape"):
        npz.write_npz(bad, path)
    assert [r.name for r in npz.read_npz(spark, path).collect()] == ["a"]
