"""Plans are the ones meant: pruned columns, pushed filters, bounded sorts."""

import os

import pytest

from notewright.operators import search, stats
from notewright.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_read_one_column(spark, tmp_path):
    spark.createDataFrame([("a", [1.0])], "source string, vector array<float>").write.parquet(str(tmp_path / "c"))
    assert "ReadSchema: struct<source:string>" in plan(stats.totals(spark.read.parquet(str(tmp_path / "c"))))


def test_lookup_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([("a", 0, 0, "x")], "source string, section int, window int, text string").write.parquet(str(tmp_path / "c"))
    assert "EqualTo(source,a)" in plan(search.chunks_of(spark.read.parquet(str(tmp_path / "c")), "a"))


def test_search_sorts_only_the_best(spark):
    found = plan(QUERIES["search_topk_l2"](spark, SF))
    assert "TakeOrderedAndProject" in found and "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
