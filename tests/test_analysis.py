"""Edge cases of profiles, plots, filters, pivots and tags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.coerce import nonfinite_to_null
from tabulon.functions.labels import column_label, format_number
from tabulon.operators import filters, pivots, plots, profiling, reports, scores, tags, topk
from tabulon.schema import ColumnError, categorical_columns, numeric_columns


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, "a", 1.0, None), (2, "a", 2.0, None), (3, "a", 3.0, None), (4, "a", 50.0, None), (5, "b", 7.0, None), (6, "b", 7.0, None),
        (7, "b", 7.0, None), (8, "c", 4.0, None), (9, None, 4.0, None), (10, "d", None, None), (11, "e", 1.0, None), (12, "e", 2.0, None),
    ]
    return spark.createDataFrame(rows, "id int, g string, x double, void double")


def test_classes(spark):
    df = spark.sql("SELECT 1 AS i, 1.5 AS d, true AS b, current_timestamp() AS t, 's' AS s")
    assert numeric_columns(df) == ["i", "d"] and categorical_columns(df) == ["b", "t", "s"]


def test_validation(df):
    for call in (
        lambda: plots.boxplot(df, "g", "g"),
        lambda: plots.histogram(df, "nope"),
        lambda: filters.predicate(df, "nope", "==", "1"),
        lambda: topk.top_groups(df, "nope", 3),
        lambda: pivots.crosstab(df, "g", "nope"),
    ):
        with pytest.raises(ColumnError):
            call()


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=500), np.arange(0, 1, 0.1), np.array([3.0, 3.0]), np.array([0.1, 0.2, 0.30000000000000004, 0.7])):
        got = plots.histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 10).collect()
        counts, edges = np.histogram(x, bins=10)
        assert [r["count"] for r in got] == counts.tolist()
        assert np.allclose([r["left"] for r in got] + [got[-1]["right"]], edges, rtol=0, atol=1e-12)


def test_histogram_without_values(df):
    got = plots.histogram(df, "void", 4).collect()
    assert [r["count"] for r in got] == [0, 0, 0, 0]


def test_boxplot_groups(df):
    got = {r["group"]: r for r in plots.boxplot(df, "x", "g").collect()}
    assert set(got) == {"a", "b", "e"}  # one-row, null and empty groups are left out
    assert (got["a"]["n_outliers"], got["a"]["whisker_high"], got["b"]["whisker_low"]) == (1, 3.0, 7.0)
    assert [tuple(r) for r in plots.boxplot_outliers(df, "x", "g").collect()] == [("a", 50.0)]


def test_top_group_ties(df):
    assert [r["g"] for r in topk.top_groups(df, "g", 3).collect()] == ["a", "b", "e"]
    assert [r["g"] for r in topk.top_groups(df.where("g IN ('c', 'd')"), "g", 1).collect()] == ["c"]


def test_density(df):
    rows = plots.density(df, "x", "g", k=3, grid=20).collect()
    for g in ("a", "b"):
        part = [r["density"] for r in rows if r["group"] == g]
        assert len(part) == 20 and sum(part) == pytest.approx(1.0)
    assert "e" not in {r["group"] for r in rows}  # two rows only
    vals = np.array([1.0, 2, 3, 50])
    q = np.percentile(vals, [25, 75])
    bw = 0.9 * min(vals.std(), (q[1] - q[0]) / 1.34) * 4 ** (-0.2)
    xs = np.linspace(1 - 4.9, 50 + 4.9, 20)
    want = np.exp(-0.5 * ((xs[:, None] - vals[None, :]) / bw) ** 2).sum(axis=1)
    assert np.allclose([r["density"] for r in rows if r["group"] == "a"], want / want.sum())


def test_flat_bandwidth(df):
    got = {r["group"]: r["bandwidth"] for r in plots.kde_bandwidth(df, "x", "g").collect()}
    assert got["b"] == 1.0


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    import pandas as pd

    n = 400
    frame = pd.DataFrame({"a": rng.normal(size=n) + 1e6, "b": rng.normal(size=n), "k": 0.1, "only": np.nan})
    frame["c"] = frame.a * 2 + rng.normal(size=n)
    frame.loc[rng.random(n) < 0.3, "b"] = np.nan
    frame["left"] = np.where(frame.b.isna(), 5.5, np.nan)  # constant, and disjoint from b
    frame["near"] = np.where(np.arange(n) < 50, 1e9 + rng.normal(size=n) * 1e-3, np.where(np.arange(n) < 60, 0.0, np.nan))
    frame["half"] = np.where(np.arange(n) < 50, rng.normal(size=n), np.nan)
    df = spark.createDataFrame(frame)
    df = nonfinite_to_null(df)
    got = {(r["x"], r["y"]): r["value"] for r in plots.correlation(df).collect()}
    want = frame.drop(columns=["only"]).corr().round(3)
    assert len(got) == 7 * 6 // 2
    for (a, b), v in got.items():
        if np.isnan(want.loc[a, b]):
            assert v is None, (a, b)
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1.1e-3), (a, b)
    matrix = plots.correlation_matrix(df, ["a", "b", "c"]).collect()
    assert len(matrix) == 9 and all(r["value"] == 1.0 for r in matrix if r["x"] == r["y"])


def test_profiles(df):
    numeric = {r["column"]: r for r in profiling.profile_numeric(df).collect()}
    assert numeric["void"]["nulls"] == 12 and numeric["void"]["mean"] is None and numeric["void"]["distinct"] == 0
    assert numeric["x"]["median"] == 4.0 and numeric["x"]["distinct"] == 6
    cat = profiling.profile_categorical(df).first()
    assert cat["top_values"] == {"a": 4, "b": 3, "e": 2, "c": 1, "d": 1} and cat["distinct"] == 5
    assert {r["column"] for r in profiling.numeric_overview(df).collect()} == {"id", "x"}
    approx = {r["column"]: r["distinct"] for r in profiling.profile_numeric(df, approx=True).collect()}
    assert approx["x"] == 6


def test_empty_table(df):
    empty = df.where("id < 0")
    assert profiling.summary(empty).first()["null_pct"] is None
    assert profiling.distribution(empty, "g").collect() == []
    assert plots.boxplot(empty, "x", "g").collect() == []
    assert plots.density(empty, "x", "g").collect() == []
    assert plots.correlation(empty).collect() == []


def test_distribution_keeps_nulls(df):
    assert ("nan", 1) in [tuple(r) for r in profiling.distribution(df, "g").collect()]
    assert len(profiling.distribution(df, "g", 2).collect()) == 2


def test_filters(df, spark):
    ids = lambda frame: sorted(r["id"] for r in frame.collect())
    assert ids(filters.filter_by(df, "g", "==", " a ")) == [1, 2, 3, 4]
    assert ids(filters.filter_by(df, "g", "!=", "a")) == [5, 6, 7, 8, 9, 10, 11, 12]
    assert ids(filters.filter_by(df, "x", "==", "7")) == [5, 6, 7]
    assert ids(filters.filter_by(df, "x", "==", "seven")) == []
    assert ids(filters.filter_by(df, "x", "!=", "seven")) == list(range(1, 13))
    assert ids(filters.filter_by(df, "id", "<=", "2.5")) == [1, 2]
    assert ids(filters.filter_by(df, "g", "contains", "^[AB]$")) == [1, 2, 3, 4, 5, 6, 7]
    assert filters.filter_counts(df, "x", ">", "4").first()["total_after"] == 4
    nan = spark.createDataFrame([(1, float("nan")), (2, 9.0)], "id int, x double")
    assert ids(filters.filter_by(nan, "x", ">", "1")) == [2]
    for operator, value in (("~", "1"), (">", "abc")):
        with pytest.raises(ValueError):
            filters.predicate(df, "x", operator, value)
    assert ids(filters.search(df, "50.")) == [4]
    assert [r["id"] for r in filters.rows_page(df, "id", 3, 2).collect()] == [4, 5]
    assert [r["id"] for r in filters.rows_after(df, "id", 5, 2).collect()] == [6, 7]
    assert filters.project(df).columns == df.columns


def test_first_complete_points(df):
    points = plots.scatter(df, "id", "x", "id", "g", 3).collect()
    assert [tuple(p) for p in points] == [(1.0, 1.0, "a"), (2.0, 2.0, "a"), (3.0, 3.0, "a")]
    assert plots.parallel_coords(df, ["id", "x"], "id").count() == 11


def test_pivots(df):
    wide = pivots.pivot_counts(df, "g", "x", [7.0, 1.0], ["b", "zz", "a"]).collect()
    assert [tuple(r) for r in wide] == [("b", 3, 0), ("a", 0, 1)]
    assert pivots.peak_group(df.where("g IN ('e', 'c', 'd') AND id <> 12"), "g", "id").first()["g"] == "c"
    assert sum(r["count"] for r in pivots.crosstab(df, "g", "x", -1).collect()) == 10


def test_trend_shares(df):
    rows = reports.trend(df, "g", "x").collect()
    total = {}
    for r in rows:
        total[r["g"]] = total.get(r["g"], 0) + r["share"]
    assert all(abs(v - 1) < 0.001 for v in total.values())


def test_reports_without_columns(spark):
    df = spark.createDataFrame([("n", "t"), ("n", "u")], "region string, ai_technique string")
    row = reports.regional_policy(df).first()
    assert (row["avg_policy_stringency"], row["open_access_rate"], row["count"]) == (0.0, 0.0, 2)
    assert reports.resource_savings(df).first()["avg_co2_reduction"] == 0.0


def test_components(spark):
    df = spark.createDataFrame([(1, 1.0, " Completed "), (2, None, "??"), (3, 5.0, None), (4, -9.0, "draft stage")], "id int, x double, s string")
    parts = {
        "rank": scores.Ranked("x"),
        "log": scores.Ranked("x", log=True),
        "none": scores.Ranked("missing"),
        "few": scores.Ranked("y"),
        "map": scores.Mapped("s", scores.STATUS_SCORES),
        "nomap": scores.Mapped("missing", scores.STATUS_SCORES),
    }
    rows = scores.with_components(df.withColumn("y", F.when(F.col("id") == 1, 2.0)), parts).orderBy("id").collect()
    assert [round(r["rank"], 6) for r in rows] == [round(2 / 3, 6), round(2 / 3, 6), 1.0, round(1 / 3, 6)]
    assert rows[3]["log"] == pytest.approx(1 / 3)
    assert {r["none"] for r in rows} == {r["few"] for r in rows} == {r["nomap"] for r in rows} == {0.5}
    assert [r["map"] for r in rows] == [1.0, 0.5, 0.5, 0.30]


def test_tags(spark):
    rows = [(1, "SDG 6, SDG 7"), (2, "SDG 6"), (3, None), (4, "none"), (5, "SDG 60; SDG 7; SDG 7")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("k", F.lit("z"))
    jaccard = {r["pair"]: (r["count"], r["jaccard"]) for r in tags.tag_jaccard(df, "t").collect()}
    assert jaccard == {"SDG 6 + SDG 7": (1, 0.3333), "SDG 60 + SDG 7": (1, 0.5)}
    outcomes = {r["tag"]: r["entries"] for r in tags.tag_outcomes(df, "t").collect()}
    assert outcomes == {"SDG 6": 2, "SDG 7": 3, "SDG 60": 1, "Other": 2}
    shares = tags.tag_shares(df, "k", "t").first()
    assert (shares["sdg6_share"], shares["sdg7_share"]) == (0.6, 0.4)
    synergy = {r["group"]: r["count"] for r in tags.tag_synergy(df, "t").collect()}
    assert synergy == {"Single Goal": 1, "Multi-Goal (Synergy)": 2}
    assert [r["tag"] for r in tags.distinct_tags(df, "t").collect()] == ["SDG 6", "SDG 60", "SDG 7"]


def test_labels(spark):
    rows = [(None,), (float("nan"),), (0.12345,), (12.0,), (-1500.0,), (2.5e6,), (3.0e9,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(format_number(F.col("x"))).collect()]
    assert got == ["-", "-", "0.1235", "12", "-1.5K", "2.5M", "3.0B"]
    assert spark.range(1).select(column_label(F.lit("funding_usd"))).first()[0] == "Funding Usd"


def test_nonfinite(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 2), (float("nan"), 3), (1.5, 4)], "x double, i int")
    assert [r["x"] for r in nonfinite_to_null(df).orderBy("i").collect()] == [None, None, None, 1.5]
