"""Plans that must stay as they are for large tables."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tabulon.operators import cleaning, filters, ordered, pivots, plots, profiling, tags, topk
from tabulon.plans.queries import QUERIES
from tests.conftest import SMALL


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_numeric_filter_and_columns_reach_the_scan(tables):
    text = plan(filters.filter_by(tables.lineitem, "l_quantity", ">", "30").select("l_orderkey"))
    assert "GreaterThan(l_quantity,30" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "EqualNullSafe(l_partkey,7)" in plan(filters.filter_by(tables.lineitem, "l_partkey", "==", "7"))


def test_top_groups_become_a_scan_filter(tables):
    rows, top = topk.complete_top(tables.lineitem, "l_returnflag", ["l_quantity"], 2)
    text = plan(rows)
    assert len(top) == 2 and "In(l_returnflag" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def test_limits_apply_before_the_shuffle(tables):
    for df in (
        cleaning.remove_duplicates(tables.lineitem, "l_partkey", "l_orderkey"),
        topk.top_values(tables.lineitem, ["l_returnflag", "l_linestatus"], 3),
    ):
        before = plan(df).split("Exchange")
        assert any("WindowGroupLimit" in part for part in before[1:]) and "WindowGroupLimit" in before[0]


@pytest.mark.parametrize("name", ["clean_ffill", "clean_interpolate", "pct_rank", "score_all", "trend_share", "tag_heatmap", "label_encode", "density"])
def test_no_window_or_product_over_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A window without partition reads only the one-row-per-bucket table.
    for node in re.findall(r"\(\d+\) Window\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", text):
        arguments = node[1]
        if re.search(r"\], \[[^\[\]]+ (ASC|DESC)[^\[\]]*\]$", arguments) and not re.search(r"\], \[[^\[\]]+\], \[", arguments):
            assert "bucket" in arguments, arguments


def test_no_python_in_plans(tables):
    df = tables.entries
    for frame in (
        profiling.summary(df),
        plots.boxplot(df, "funding_usd", "region"),
        plots.density(df, "funding_usd", "region"),
        tags.tag_jaccard(df, "sdg_alignment"),
        pivots.crosstab(df, "region", "sector"),
        ordered.fill_forward(df, ["investment_roi"], "row_id"),
    ):
        text = plan(frame)
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroups", text)


def test_entries_send_no_growing_table_to_the_driver(tables):
    text = plan(tables.entries.select("row_id", "funding_usd", "sector", "title"))
    assert len(re.findall(r"^\(\d+\) SortMergeJoin", text, re.M)) == 3
    for key in ("c_custkey", "p_partkey", "doc_id"):
        assert not any("BroadcastExchange" in node and key in node for node in re.split(r"\n\n+", text))


def test_passes_of_sequential_filters_read_a_written_copy(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id", "if(id % 100 = 0, id * 1000.0D, id % 7 * 1.0D) as x", "if(id % 3 = 0, null, id % 11 * 1.0D) as y").repartition(40, "id")
    tasks, bounds = [], cleaning._iqr_bounds
    monkeypatch.setattr(cleaning, "_iqr_bounds", lambda d, *a: tasks.append(d.rdd.getNumPartitions()) or bounds(d, *a))
    kept = cleaning.remove_outliers_iqr_keep_nulls(df, ["x", "y"])
    # the copy has no partition for each one of the shuffle
    assert len(tasks) == 2 and max(tasks) < 40
    assert kept.count() == 4000 - 39 and kept.where("x > 6").count() == 0
