"""A run deletes what it has written and nothing else."""

import os
import threading

import pytest

from attestor.llm import common
from attestor.session import application_dir


def folders(spark):
    return set(os.listdir(application_dir(spark).removeprefix("file://").removeprefix("file:")))


def test_runs_side_by_side(spark):
    """A lazy result that another thread, or code before the run, has made outlives the run."""
    before = folders(spark)
    outer, made, go, other = common.written(spark.range(5).toDF("a"), "outer"), threading.Event(), threading.Event(), []

    def beside():
        other.append(common.written(spark.range(7).toDF("b"), "beside"))
        made.set()
        go.wait(60)
        with common.own_run(spark) as keep:
            common.written(spark.range(1).toDF("x"), "lost")
            other.append(common.written(spark.range(9).toDF("c"), "kept"))
            keep(other[1])

    t = threading.Thread(target=beside)
    with common.own_run(spark) as keep:
        t.start()
        assert made.wait(60)
        mine = common.written(spark.range(3).toDF("d"), "mine")
        common.written(spark.range(2).toDF("e"), "on_the_way")
        keep(mine)
    go.set()
    t.join(60)
    assert [d.count() for d in (outer, mine, *other)] == [5, 3, 7, 9]
    assert sorted(x.split("-")[0] for x in folders(spark) - before) == ["beside", "kept", "mine", "outer"]
    common.discard(outer, mine, *other)
    assert folders(spark) == before


def test_failed_run_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError):
        with common.own_run(spark):
            common.written(spark.range(3).toDF("a"), "lost")
            1 / 0
    assert folders(spark) == before
