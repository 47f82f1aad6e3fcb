"""Junk is found without dealing files out by their names."""

import pytest

from corpusforge.operators import tree
from corpusforge.queries import QUERIES


@pytest.mark.parametrize("limits", [(1 << 20, 9), (1 << 20, 0), (0, 0)])
def test_dirty_files_are_not_dealt_out_by_name(spark, limits):
    rows = [("r", f"/d{k}", "junk.url") for k in range(300)] + [("r", "/e", "junk"), ("r", "/e", "a.txt"), ("r", "/e", "a"), ("r", "/e", "a"), ("s", "", "b.c.d"), ("s", "", None)]
    files = spark.createDataFrame(rows, "root string, dir string, name string")
    names = spark.createDataFrame([("junk",), ("a",), ("junk",), (None,), ("b.c.d",), ("gone",)], "name string")
    out = tree.dirty_files(files, names, *limits)
    assert sorted(map(tuple, out.collect())) == sorted(set(rows) - {("s", "", None)})
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    # With a limit of nothing only files whose name few of them have are shuffled by it.
    assert "SortMergeJoin" not in plan if limits[0] else "BroadcastHashJoin" in plan
    assert "Join" not in plan if limits[1] else True


def test_the_query_shuffles_junk_alone(spark):
    plan = QUERIES["q_dirty"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    below = plan[plan.rindex("Aggregate") :]
    assert "Filter" in below and "junk" in below[below.index("Filter") :]
