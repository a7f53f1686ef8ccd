"""Synthetic rows that follow the column distributions of a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.coerce import number_of
from tabulon.operators.profiling import distinct_counts
from tabulon.operators.topk import top_values
from tabulon.schema import categorical_columns, numeric_columns, ref

CATEGORIES = 50
ROWS_PER_TASK = 2_000_000


def _numeric_stats(df: DataFrame) -> dict[str, tuple | None]:
    """(min, max, mean, std) per numeric column in one aggregate; None without values."""
    columns = numeric_columns(df)
    if not columns:
        return {}
    wanted = {"lo": F.min, "hi": F.max, "mean": F.avg, "std": F.stddev_samp}
    row = df.agg(*[f(number_of(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in wanted.items()]).first()
    return {c: None if row[f"lo{i}"] is None else tuple(row[f"{k}{i}"] for k in wanted) for i, c in enumerate(columns)}


def generator_schema(df: DataFrame) -> DataFrame:
    """What ``generate`` learns: range and moments of numeric columns, the most
    frequent values of the others with their share, one row per column and value."""
    rows = [
        (c, dict(df.dtypes)[c], *(float(v or 0.0) for v in stats or (0.0,) * 4)) for c, stats in _numeric_stats(df).items()
    ]
    spark = df.sparkSession
    numeric = spark.createDataFrame(rows, "column string, dtype string, min double, max double, mean double, std double")
    numeric = numeric.withColumn("type", F.lit("numeric"))
    columns = categorical_columns(df)
    if not columns:
        return numeric
    known = df.agg(*[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    totals = known.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])))
    categories = (
        top_values(df, columns, CATEGORIES)
        .join(F.broadcast(totals), "column")
        .join(F.broadcast(distinct_counts(df, columns)), "column")
        .select(
            "column",
            F.create_map(*[F.lit(p) for c in columns for p in (c, dict(df.dtypes)[c])])[F.col("column")].alias("dtype"),
            F.lit("categorical").alias("type"),
            F.col("value").alias("category"),
            (F.col("count") / F.col("n")).alias("prob"),
            F.col("distinct").alias("unique_count"),
        )
    )
    return numeric.unionByName(categories, allowMissingColumns=True)


def _uniform(seed: int, column: str, draw: int) -> Column:
    """A number in (0, 1) that depends only on row id, seed and column: the same
    under any partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(column), F.lit(draw)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(2**53))


def _normal(seed: int, column: str) -> Column:
    angle = _uniform(seed, column, 1) * (2 * math.pi)
    return F.sqrt(-2 * F.log(_uniform(seed, column, 0))) * F.cos(angle)


def generate(df: DataFrame, n: int, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """n new rows: clipped normal draws for numbers, draws from the most frequent
    values for the rest. Statistics are read once; rows are made in parallel."""
    n, noise = max(int(n), 1), max(0.0, min(float(noise), 1.0))
    stats = _numeric_stats(df)
    columns = categorical_columns(df)
    values: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    if columns:
        for row in top_values(df, columns, CATEGORIES).orderBy("column", "rank").collect():
            values[row["column"]].append((row["value"], row["count"]))

    def number(name: str) -> Column:
        kind = df.schema[name].dataType
        if stats[name] is None:
            return F.lit(0).cast(kind)
        lo, hi, mean, std = stats[name]
        drawn = F.lit(mean) + _normal(seed, name) * F.lit(max(std or 0.0, 0.01) * (1 + noise))
        if isinstance(kind, T.IntegralType):
            drawn = F.round(drawn)
        return F.greatest(F.lit(lo), F.least(F.lit(hi), drawn)).cast(kind)

    def category(name: str) -> Column:
        kind = df.schema[name].dataType
        if not values[name]:
            return F.lit("").cast(kind) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
        total, upto, limits = sum(k for _, k in values[name]), 0, []
        for _, k in values[name][:-1]:
            upto += k
            limits.append(upto / total)
        place = F.size(F.filter(F.array(*map(F.lit, limits)).cast("array<double>"), lambda limit: limit <= _uniform(seed, name, 0)))
        return F.get(F.array(*[F.lit(v) for v, _ in values[name]]), place).cast(kind)

    spark = df.sparkSession
    rows = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, math.ceil(n / ROWS_PER_TASK)))
    return rows.select(*[(number(c) if c in stats else category(c)).alias(c) for c in df.columns])
