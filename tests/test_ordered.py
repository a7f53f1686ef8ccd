"""Scalable forms against pandas and numpy, on ties, gaps and heavy tails."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import ordered, quantiles
from tabulon.schema import ColumnError

PROBS = [0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.9, 1]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(1)
    n = 3000
    frame = pd.DataFrame(
        {
            "id": np.arange(n) * 3 + 5,
            "x": np.where(rng.random(n) < 0.4, 7.0, np.exp(rng.normal(size=n) * 4)),
            "y": np.round(rng.normal(size=n), 1),
            "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        }
    )
    frame.loc[rng.random(n) < 0.1, "x"] = np.nan
    frame.loc[[0, 1, n - 1], "x"] = np.nan
    frame.loc[1000:1900, "x"] = np.nan  # a gap over several buckets
    return frame


@pytest.fixture(scope="module")
def df(spark, pdf):
    frame = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return frame.repartition(5).persist()


def back(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("ranked", [20, 10_000])
def test_narrowed_quantiles(df, pdf, ranked):
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("x")) for c in "xy"]))).dropna()
    found = quantiles._interpolated(values, PROBS, ranked)
    for c in "xy":
        assert np.allclose(found[c], pdf[c].quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_group_quantiles(df, pdf, limit):
    found = quantiles.group_quantiles(df.dropna(), "g", "x", [0.25, 0.5], len(pdf), limit).collect()
    want = pdf.dropna().groupby("g").x.quantile([0.25, 0.5]).unstack()
    assert {r["g"] for r in found} == {"a", "b", "c"}
    for row in found:
        assert np.allclose(row["q"], want.loc[row["g"]])


def test_column_quantiles_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    for limit in (0, 100):
        assert quantiles.column_quantiles(df, ["a", "b"], [0.5], limit) == {"a": [2.0], "b": None}
    with pytest.raises(ColumnError):
        quantiles.column_quantiles(df, ["c"], [0.5])


@pytest.mark.parametrize("size", [97, 10**6])
def test_fills(df, pdf, size):
    kw = {"rows_per_bucket": size}
    assert np.allclose(back(ordered.fill_forward(df, ["x"], "id", **kw)).x, pdf.x.ffill(), equal_nan=True)
    assert np.allclose(back(ordered.fill_backward(df, ["x"], "id", **kw)).x, pdf.x.bfill(), equal_nan=True)
    assert np.allclose(back(ordered.interpolate(df, "x", "id", **kw)).x, pdf.x.interpolate(), equal_nan=True)


def test_fill_by_timestamp(spark):
    rows = [("2024-01-03", None), ("2024-01-01", "a"), ("2024-01-02", None), ("2024-01-04", "b")]
    df = spark.createDataFrame(rows, "d string, v string").withColumn("d", F.to_timestamp("d"))
    got = [r["v"] for r in ordered.fill_forward(df, ["v"], "d", rows_per_bucket=1).orderBy("d").collect()]
    assert got == ["a", "a", "a", "b"]


def test_fill_needs_an_order(spark):
    with pytest.raises(ColumnError):
        ordered.fill_forward(spark.createDataFrame([("a", 1)], "k string, v int"), ["v"], "k")


def test_all_null_column_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert [r["x"] for r in ordered.interpolate(df, "x", "id").collect()] == [None, None]
    empty = df.where("id > 5")
    assert ordered.fill_forward(empty, ["x"], "id").collect() == []
    assert ordered.pct_rank(empty, "x").collect() == []


@pytest.mark.parametrize("broadcast", [5, 10**6])
def test_ranks(df, pdf, broadcast):
    tables = ordered.rank_tables(df, {"x": F.col("x"), "y": F.col("y")}, 100, broadcast)
    assert (not tables.small) == (broadcast == 5)
    got = back(ordered.with_rank(ordered.with_rank(df, F.col("x"), tables, "x", "rx"), F.col("y"), tables, "y", "ry"))
    assert np.allclose(got.rx, pdf.x.rank(pct=True), equal_nan=True)
    assert np.allclose(got.ry, pdf.y.rank(pct=True))
    medians = tables.medians()
    for c in "xy":
        assert medians[c] == pytest.approx(pdf[c].rank(pct=True).median(), abs=1e-15)


def test_dense_codes(spark):
    values = [f"v{(i * 7919) % 1000:04d}" for i in range(3000)] + ["é", "Z", "", "𝄞", "ﬀ", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = {r["value"]: r["code"] for r in ordered.dense_codes(df, "v", 16).collect()}
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert got == {v: i for i, v in enumerate(want)}


def test_deep_page(df, pdf):
    from tabulon.operators.filters import rows_page

    for offset in (0, 5, 1234, 2990, 3000, 9999):
        got = [r["id"] for r in rows_page(df, "id", offset, 20, deep=4).collect()]
        assert got == pdf.id.tolist()[offset : offset + 20], offset


def test_ranges_of_codes_grow_with_the_values(spark, monkeypatch):
    made, scratch = {}, ordered.scratch_dir
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 200)
    monkeypatch.setattr(ordered, "scratch_dir", lambda session, label: made.setdefault(label, scratch(session, label)))
    df = spark.range(20_000).selectExpr("concat('v', lpad(cast(id % 10000 AS string), 5, '0')) AS v")
    got = {r["value"]: r["code"] for r in ordered.dense_codes(df, "v").collect()}
    assert got == {f"v{k:05}": k for k in range(10_000)}
    sizes = [r["count"] for r in spark.read.parquet(made["codes"]).groupBy("bucket").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 1_000
