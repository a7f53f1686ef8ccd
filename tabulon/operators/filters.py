"""Row filters, search and paging."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.coerce import number_of, strip
from tabulon.operators.ordered import range_buckets
from tabulon.schema import float_columns, is_numeric, ref, require

COMPARISONS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}
OPERATORS = ("==", "!=", *COMPARISONS, "contains")
DEEP_OFFSET = 100_000


def predicate(df: DataFrame, column: str, operator: str, value: str) -> Column:
    """Condition on one column; null counts as false.

    Numeric columns are compared as bare columns, so that the scan can use the
    filter.
    """
    require(df, column)
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator: {operator}")
    if operator == "contains":
        return ref(column).cast("string").rlike("(?i)" + value)
    if operator in ("==", "!="):
        same = _equals(df, column, value)
        return same if operator == "==" else ~same
    limit = _number(value)
    if limit is None:
        raise ValueError(f"not a number: {value!r}")
    if not is_numeric(df, column):
        return COMPARISONS[operator](number_of(df, column), F.lit(limit))
    compared = COMPARISONS[operator](ref(column), F.lit(limit))
    # NaN is greater than everything in Spark.
    return compared & ~F.isnan(ref(column)) if column in float_columns(df) else compared


def _number(text: str) -> int | float | None:
    """Whole numbers as int: an integer column is then compared without a cast."""
    for kind in (int, float):
        try:
            return kind(text.strip())
        except ValueError:
            continue
    return None


def _equals(df: DataFrame, column: str, value: str) -> Column:
    wanted = value.strip()
    if is_numeric(df, column):
        number = _number(wanted)
        return F.lit(False) if number is None else ref(column).eqNullSafe(F.lit(number))
    return strip(ref(column).cast("string")).eqNullSafe(F.lit(wanted))


def filter_by(df: DataFrame, column: str, operator: str, value: str) -> DataFrame:
    return df.where(predicate(df, column, operator, value))


def filter_counts(df: DataFrame, column: str, operator: str, value: str) -> DataFrame:
    """One row: rows before and after the filter."""
    return df.agg(
        F.count(F.lit(1)).alias("total_before"),
        F.count_if(predicate(df, column, operator, value)).alias("total_after"),
    )


def filter_page(df: DataFrame, column: str, operator: str, value: str, order_by: str, limit: int = 100) -> DataFrame:
    """First matching rows in ``order_by`` order."""
    require(df, order_by)
    return filter_by(df, column, operator, value).orderBy(ref(order_by)).limit(limit)


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Free SQL condition. An invalid one raises when the plan is analysed."""
    filtered = df.where(F.expr(expression))
    filtered.schema  # analyse now
    return filtered


def rows_page(df: DataFrame, order_by: str, offset: int = 0, limit: int = 100, deep: int = DEEP_OFFSET) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order_by`` order.

    A sort with an offset brings all skipped rows to one task. For a deep offset
    the rows are counted per order range first, and only the ranges that cover
    the page are sorted.
    """
    require(df, order_by)
    if offset > deep:
        cut, bucket = range_buckets(df, order_by)
        upto, first, last, skipped = 0, None, None, 0
        for row in cut.groupBy(bucket).count().orderBy(bucket).collect():
            if first is None and upto + row["count"] > offset:
                first, skipped = row[bucket], upto
            upto += row["count"]
            last = row[bucket]
            if upto >= offset + limit:
                break
        if first is None:
            return df.limit(0)
        df = cut.where(F.col(bucket).between(first, last)).drop(bucket)
        offset -= skipped
    return df.orderBy(ref(order_by)).offset(offset).limit(limit)


def rows_after(df: DataFrame, order_by: str, last, limit: int = 100) -> DataFrame:
    """Next page after the last key seen: no rows before it are sorted or skipped."""
    require(df, order_by)
    return df.where(ref(order_by) > F.lit(last)).orderBy(ref(order_by)).limit(limit)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any cell, ignoring case."""
    wanted = F.lit(text.lower())
    hits = [F.coalesce(F.lower(ref(c).cast("string")).contains(wanted), F.lit(False)) for c in df.columns]
    return df.where(reduce(or_, hits))


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chosen columns; the first twelve by default."""
    names = df.columns[:12] if columns is None else columns
    require(df, *names)
    return df.select(*[ref(c) for c in names])
