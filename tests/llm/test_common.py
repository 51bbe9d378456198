"""The shared folder and its tables."""

import os

from tessel.llm.common import WRITTEN, clean, shared_dir, used_up, written


def test_written_tables(spark):
    got = written(spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS x"), "numbers")
    folder = WRITTEN[-1].removeprefix("file://")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4] and WRITTEN[-1].startswith(shared_dir(spark)) and os.path.isdir(folder)
    clean(spark)
    assert not WRITTEN and not os.path.exists(folder)


def test_used_up_tables(spark):
    first, second = written(spark.range(3), "first"), written(spark.range(4), "second")
    at, left = (x.removeprefix("file://") for x in WRITTEN[-2:])
    used_up(first)
    used_up(first)  # twice, and a frame that isn't a written table, do nothing
    used_up(spark.range(1))
    assert not os.path.exists(at) and os.path.isdir(left) and second.count() == 4
    clean(spark)
    used_up(second)
    assert not os.path.exists(left)
