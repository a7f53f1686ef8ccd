"""Most frequent groups and values. Ties always break by value ascending."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.coerce import finite
from tabulon.schema import float_columns, ref, require
from tabulon.session import checkpointed


def top_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """The k most frequent non-null groups as ``(group, count)``."""
    require(df, group)
    return (
        df.where(ref(group).isNotNull())
        .groupBy(ref(group).alias(group))
        .count()
        .orderBy(F.desc("count"), ref(group))
        .limit(k)
    )


def in_top_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """Rows of the k most frequent groups. The broadcast side has at most k rows."""
    return df.join(F.broadcast(top_groups(df, group, k).select(ref(group))), group, "left_semi")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group. The rank filter is also applied before the
    shuffle, so a hot group sends k rows per task."""
    window = Window.partitionBy(*[ref(c) for c in by]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` for all given columns in one pass; nulls left out."""
    require(df, *columns)
    cells = df.select(*[ref(c).cast("string").alias(c) for c in columns])
    return (
        cells.unpivot([], list(columns), "column", "value")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .count()
    )


#: Columns whose distinct values take more bytes than this are counted by hashes of the values.
DIRECT_BYTES = 64_000_000
#: Values of equal count that are looked up by hash, and smallest values of a column that are tried before.
MOST_TIES, SMALLEST = 10_000, 1_000


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10, direct_bytes: int = DIRECT_BYTES) -> DataFrame:
    """The k most frequent values of each column, ``rank`` from 1.

    Short lists of values are counted as they are. Where the distinct values of a
    column are large, as in free texts and ids, its values are counted by hash, and
    only the values that can be among the first are counted again themselves.
    """
    require(df, *columns)
    sizes = df.agg(*[F.struct(F.approx_count_distinct(ref(c)), F.avg(F.octet_length(ref(c).cast("string")))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    large = [c for c, (distinct, size) in zip(columns, sizes) if distinct * (size or 0) > direct_bytes]
    small = [c for c in columns if c not in large]
    counts = [value_counts(df, small)] if small else []
    if large:
        counts.append(leading_counts(df, large, k))
    counted = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    return top_per_group(counted, ["column"], [F.desc("count"), F.col("value")], k)


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = df.select(*[ref(c).cast("string").alias(c) for c in columns])
    return cells.unpivot([], list(columns), "column", "value").where("value IS NOT NULL")


def leading_counts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``(column, value, count)``: exact counts of a few values of each column, the k most
    frequent ones among them, without a shuffle of the values.

    No value is more frequent than its hash. With ``floor`` the k-th largest count of a
    hash, values of more frequent hashes (fewer than k) are counted again, and so are
    those of the floor itself if they are few. Many values of that count, as in a column
    of ids, are in the answer by the order of the values: the smallest values of the
    column are counted by their hashes, and if enough of them have that count no others
    can be ahead. Where this does not settle a column, all its values are counted.
    """
    cells = _cells(df, columns).withColumn("hash", F.xxhash64("value"))
    hashes = checkpointed(cells.groupBy("column", "hash").count())
    first = top_per_group(hashes, ["column"], [F.desc("count"), F.col("hash")], k, "place")
    floors = first.groupBy("column").agg(F.min("count").alias("floor"))
    above = F.count_if(F.col("count") > F.col("floor"))
    state = {r["column"]: r for r in hashes.join(F.broadcast(floors), "column").groupBy("column", "floor").agg(above.alias("above"), F.count_if(F.col("count") == F.col("floor")).alias("ties")).collect()}
    spark = df.sparkSession
    few = [c for c, r in state.items() if r["ties"] <= MOST_TIES]
    least = spark.createDataFrame([(c, r["floor"] + (c not in few)) for c, r in state.items()], "column string, least bigint")
    wanted = hashes.join(F.broadcast(least), "column").where("count >= least").select("column", "hash")
    again = cells.join(F.broadcast(wanted), ["column", "hash"], "left_semi").groupBy("column", "value").count()
    many = [c for c in state if c not in few]
    if not many:
        return again
    smallest = [_smallest(df, c, SMALLEST) for c in many]
    tried = checkpointed(reduce(DataFrame.unionByName, smallest).withColumn("hash", F.xxhash64("value")))
    met = hashes.join(F.broadcast(tried), ["column", "hash"]).select("column", "value", "count")
    tied = met.join(F.broadcast(floors), "column").where("count = floor").select("column", "value", "count")
    enough = {r["column"]: r["count"] for r in tied.groupBy("column").count().collect()}
    settled = [c for c in many if enough.get(c, 0) >= k - state[c]["above"]]
    if settled:
        again = again.unionByName(tied.where(F.col("column").isin(settled)))
    rest = [c for c in many if c not in settled]
    if rest:
        again = again.where(~F.col("column").isin(rest)).unionByName(value_counts(df, rest))
    return again


def _smallest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n smallest distinct values of a column, as text; every task passes at most n on."""
    values = _cells(df, [column]).select("column", "value")
    kept = values.withColumn("place", F.dense_rank().over(Window.partitionBy("column").orderBy("value"))).where(F.col("place") <= n)
    return kept.select("column", "value").distinct()


def complete_top(df: DataFrame, group: str, columns: Sequence[str], k: int) -> tuple[DataFrame, list[tuple]]:
    """Complete cases over group and columns, cut to the k largest groups.

    Also returns ``(group, count)`` of these groups, largest first. The group
    values become a literal filter, which the scan can use.
    """
    require(df, group, *columns)
    floats = set(float_columns(df))
    cells = [finite(ref(c)).alias(c) if c in floats else ref(c) for c in dict.fromkeys([group, *columns])]
    complete = df.select(*cells).dropna()
    top = [tuple(row) for row in top_groups(complete, group, k).collect()]
    return complete.where(ref(group).isin([value for value, _ in top])), top
