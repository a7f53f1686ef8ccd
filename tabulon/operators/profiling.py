"""Table summaries, column profiles and simple grouped counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.coerce import finite, number_of
from tabulon.operators.quantiles import column_median
from tabulon.operators.topk import top_per_group, top_values, value_counts
from tabulon.schema import ColumnError, categorical_columns, numeric_columns, ref, require, require_numeric


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), 2)


def _nulls(name: str) -> Column:
    return F.count_if(ref(name).isNull())


def _long(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One-row frame to one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def summary(df: DataFrame) -> DataFrame:
    """Rows, columns, column classes and the share of null cells; one pass."""
    total = sum((_nulls(c) for c in df.columns), F.lit(0))
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), total.alias("total_nulls")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        names(df.columns).alias("column_names"),
        F.lit(len(numeric)).alias("numeric_columns"),
        F.lit(len(categorical)).alias("categorical_columns"),
        names(numeric).alias("numeric_cols"),
        names(categorical).alias("categorical_cols"),
        "total_nulls",
        percent(F.col("total_nulls"), F.col("total_rows") * len(df.columns)).alias("null_pct"),
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, names, types as a map, share of null cells."""
    types = F.create_map(*[F.lit(part) for pair in df.dtypes for part in pair])
    return summary(df).select(
        F.col("total_rows").alias("rows"),
        F.col("total_columns").alias("columns"),
        "column_names",
        types.alias("dtypes"),
        "null_pct",
    )


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, dtype, nulls, null_pct)`` in one wide aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[_nulls(c).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return _long(
        row,
        [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("dtype"),
                F.col(f"n{i}").alias("nulls"),
                percent(F.col(f"n{i}"), F.col("rows")).alias("null_pct"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ],
    )


def null_report(df: DataFrame) -> DataFrame:
    return null_counts(df).where("null_pct > 0").orderBy(F.desc("null_pct"), "column")


def column_health(df: DataFrame) -> DataFrame:
    health = F.when(F.col("null_pct") == 0, "ok").when(F.col("null_pct") < 10, "warn").otherwise("bad")
    return null_counts(df).withColumn("health", health)


def _value_kind(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return "double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "string"


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column, distinct)`` of non-null values. The exact form shuffles each
    distinct value once; ``approx`` shuffles only sketches."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(ref(c), 0.02).alias(f"d{i}") for i, c in enumerate(columns)])
        return _long(row, [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)])
    kinds = {c: _value_kind(df, c) for c in columns}
    used = sorted(set(kinds.values()))
    cells = []
    for c in columns:
        cells.append(F.lit(c))
        cells += [ref(c).cast(kind) if kind == kinds[c] else F.lit(None).cast(kind) for kind in used]
    # Numbers travel as numbers: half the size of their text, and no formatting.
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("column", *used))
    values = [finite(F.col(kind)) if kind == "double" else F.col(kind) for kind in used]
    known = reduce(or_, [value.isNotNull() for value in values])
    return long.where(known).groupBy("column", *used).agg(F.count(F.lit(1))).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def _numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, total, mean, median, min, max, std, nulls, null_pct)``.

    One wide aggregate, whose row count then tells how to take the medians.
    """
    stats = {"total": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        x = number_of(df, name)
        aggregates += [f(x).alias(f"{key}{i}") for key, f in stats.items()]
        aggregates.append(F.count(x).alias(f"n{i}"))
    row = df.agg(*aggregates).first()
    medians = column_median(df, columns, rows=row["rows"])
    cells = [
        (name, row[f"total{i}"], row[f"mean{i}"], medians[name], row[f"min{i}"], row[f"max{i}"], row[f"std{i}"], row["rows"], row["rows"] - row[f"n{i}"])
        for i, name in enumerate(columns)
    ]
    schema = "column string, total double, mean double, median double, min double, max double, std double, rows bigint, nulls bigint"
    return df.sparkSession.createDataFrame(cells, schema).select(
        "column", "total", "mean", "median", "min", "max", "std", "nulls",
        percent(F.col("nulls"), F.col("rows")).alias("null_pct"),
        (F.col("rows") > F.col("nulls")).alias("has_values"),
    )


def numeric_overview(df: DataFrame, max_cols: int = 12) -> DataFrame:
    """Statistics of the first numeric columns; columns without values left out."""
    columns = numeric_columns(df)[:max_cols]
    if not columns:
        raise ColumnError("no numeric column")
    return _numeric_stats(df, columns).where("has_values").drop("has_values")


def profile_numeric(df: DataFrame, approx: bool = False) -> DataFrame:
    columns = numeric_columns(df)
    if not columns:
        raise ColumnError("no numeric column")
    types = F.create_map(*[F.lit(p) for c in columns for p in (c, dict(df.dtypes)[c])])
    stats = _numeric_stats(df, columns).drop("has_values", "total")
    distinct = distinct_counts(df, columns, approx)
    return stats.join(F.broadcast(distinct), "column", "left").select(
        "column",
        types[F.col("column")].alias("dtype"),
        "nulls",
        "null_pct",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "min",
        "max",
        "mean",
        "median",
        "std",
    )


def profile_categorical(df: DataFrame, k: int = 10, approx: bool = False) -> DataFrame:
    """Nulls, distinct values and the top values as a map, per non-numeric column."""
    columns = categorical_columns(df)
    if not columns:
        raise ColumnError("no categorical column")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    top = (
        top_values(df, columns, k)
        .groupBy("column")
        .agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["value"], p["count"]))).alias("top_values"))
    )
    distinct = distinct_counts(df, columns, approx)
    return (
        null_counts(df.select(*[ref(c) for c in columns]))
        .join(F.broadcast(distinct), "column", "left")
        .join(F.broadcast(top), "column", "left")
        .withColumn("distinct", F.coalesce("distinct", F.lit(0)))
        .select("column", "dtype", "nulls", "null_pct", "distinct", "top_values")
    )


def profile_columns(df: DataFrame, k: int = 10, approx: bool = False) -> DataFrame:
    """Profile of every column, numeric and categorical measures side by side."""
    parts = []
    if numeric_columns(df):
        parts.append(profile_numeric(df, approx))
    if categorical_columns(df):
        parts.append(profile_categorical(df, k, approx))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def distribution(df: DataFrame, column: str, k: int = 50, null_label: str = "nan") -> DataFrame:
    """Value counts with nulls as a value of their own, most frequent first."""
    require(df, column)
    return (
        df.groupBy(ref(column).alias("cell"))
        .count()
        .orderBy(F.desc("count"), F.asc_nulls_last("cell"))
        .limit(k)
        .select(F.coalesce(F.col("cell").cast("string"), F.lit(null_label)).alias("value"), "count")
    )


def temporal(df: DataFrame, group: str = "year") -> DataFrame:
    require(df, group)
    return df.where(ref(group).isNotNull()).groupBy(ref(group).alias(group)).count().orderBy(ref(group))


def funding_by_period(df: DataFrame, time: str = "year", x: str = "funding_usd") -> DataFrame:
    """Sum, mean and count per period, also in millions."""
    require(df, time)
    require_numeric(df, x)
    cells = df.select(number_of(df, time).cast("bigint").alias(time), number_of(df, x).alias("x")).dropna()
    return (
        cells.groupBy(time)
        .agg(F.sum("x").alias("total_funding"), F.avg("x").alias("average_funding"), F.count("x").alias("count"))
        .withColumn("total_funding_m", F.round(F.col("total_funding") / 1e6, 2))
        .withColumn("average_funding_m", F.round(F.col("average_funding") / 1e6, 2))
        .orderBy(time)
    )


def categorical_breakdown(df: DataFrame, max_cols: int = 8, lo: int = 2, hi: int = 80, k: int | None = 20) -> DataFrame:
    """Value counts of those of the first categorical columns that have a
    moderate number of values; at most k values each."""
    columns = categorical_columns(df)[:max_cols]
    if not columns:
        raise ColumnError("no categorical column")
    counts = value_counts(df, columns)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")).where(F.col("distinct").between(lo, hi))
    kept = counts.join(F.broadcast(sizes.select("column")), "column", "left_semi")
    top = top_per_group(kept, ["column"], [F.desc("count"), F.col("value")], hi if k is None else k)
    return top.select("column", "value", "count", "rank").orderBy("column", "rank")


def kpis(df: DataFrame, mean_of: Sequence[str] = ("funding_usd", "impact_score")) -> DataFrame:
    """Rows, column classes and the mean of a few measures."""
    require_numeric(df, *mean_of)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(categorical_columns(df))).alias("categorical_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        *[F.avg(number_of(df, c)).alias(f"avg_{c}") for c in mean_of],
    )
