"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabulon.session import scratch_dir

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(r"[^\x20\x09-\x0d]+").findall

#: Rows that one window or sort bucket is meant to hold.
BUCKET_ROWS = 50_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64-bit hash over all columns: equal for identical rows only, but for chance."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(df[f"`{c}`"])) if "map<" in kind else df[f"`{c}`"] for c, kind in df.dtypes])


def bits_for(rows: int, per_bucket: int = BUCKET_ROWS, most: int = 30) -> int:
    """Bits that split ``rows`` evenly hashed rows into buckets of about ``per_bucket``."""
    return min(most, max(0, math.ceil(math.log2(max(rows, 1) / per_bucket))))


def top_bits(hashed: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit hash, as a number that grows with the hash."""
    return (F.shiftright(hashed, 64 - bits) + F.lit(1 << bits >> 1).cast("long")) if bits else F.lit(0).cast("long")


def running(df: DataFrame, groups: list[str], bucket: Column, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Running total of ``value`` within ``groups``, the row itself included.

    ``bucket`` must not decrease along ``order``. Each bucket is one window
    partition; what crosses buckets is one sum per group and bucket.
    """
    cut = df.withColumns({"__bucket": bucket, "__value": value})
    keys = [*groups, "__bucket"]
    sums = cut.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = cut.withColumn("__inside", F.sum("__value").over(inside))
    return total.join(starts, keys).withColumn(out, F.col("__start") + F.col("__inside")).drop("__bucket", "__value", "__inside", "__start")


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it from there: later jobs do not
    repeat it, and it survives the loss of executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``a``, ``b`` (long).

    Returns ``node`` and ``root``, the smallest node of its component, for every
    node of an edge between two different nodes. Alternates large and small
    star steps; every round is written to the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "edges")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        pairs = written(small, "edges")
        now = pairs.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if tuple(now) == state and now[0] == now[3]:
            break
        state = tuple(now)
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Memo(dict):
    """``memo[key]`` is ``make(key)``, kept; emptied at ``most`` entries, so that a task's memory is bounded."""

    def __init__(self, make: Callable, most: int = 1_000_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
