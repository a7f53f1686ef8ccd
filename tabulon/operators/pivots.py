"""Cross-tabs, pivots and arg-max groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabulon.operators.topk import top_groups
from tabulon.schema import ref, require


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, count, share)`` with the share within a, 4 digits. Totals are a
    grouped table of their own: no window has to hold all members of a hot a."""
    require(df, a, b)
    counts = df.where(ref(a).isNotNull() & ref(b).isNotNull()).groupBy(ref(a).alias(a), ref(b).alias(b)).count()
    totals = counts.groupBy(ref(a).alias("__a")).agg(F.sum("count").alias("__total"))
    joined = counts.join(totals, ref(a) == F.col("__a"))
    return joined.select(ref(a), ref(b), "count", F.round(F.col("count") / F.col("__total"), 4).alias("share"))


def crosstab(df: DataFrame, a: str, b: str, min_share: float = 0.01) -> DataFrame:
    """Counts of (a, b) and the share within a; small shares are left out after rounding."""
    return pair_counts(df, a, b).where(F.col("share") > min_share)


def pivot_counts(df: DataFrame, rows: str, cols: str, col_values: Sequence, row_values: Sequence | None = None) -> DataFrame:
    """Counts with one row per row value and one column per given column value.

    ``row_values`` fixes rows and their order; absent ones are skipped. Without
    it all non-null rows come in ascending order.
    """
    require(df, rows, cols)
    kept = df.where(ref(rows).isin(list(row_values)) if row_values is not None else ref(rows).isNotNull())
    wide = kept.groupBy(ref(rows).alias(rows)).pivot(cols, list(col_values)).count()
    wide = wide.select(ref(rows), *[F.coalesce(ref(c), F.lit(0)).alias(c) for c in wide.columns if c != rows])
    if row_values is None:
        return wide.orderBy(ref(rows))
    place = F.array_position(F.array(*[F.lit(v) for v in row_values]), ref(rows))
    return wide.orderBy(place)


def top_pivot(df: DataFrame, rows: str, cols: str, k: int) -> DataFrame:
    """``pivot_counts`` over the k most frequent column values."""
    values = [row[cols] for row in top_groups(df, cols, k).collect()]
    return pivot_counts(df, rows, cols, values)


def peak_group(df: DataFrame, group: str, member: str) -> DataFrame:
    """The group with the most rows that have a member; the smallest one on ties."""
    require(df, group, member)
    return top_groups(df.where(ref(member).isNotNull()), group, 1).select(ref(group), F.col("count").alias("total"))
