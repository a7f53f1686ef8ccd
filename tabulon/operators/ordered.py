"""Order-dependent operators: range buckets, carried fills, interpolation, ranks.

A window over a whole table would run in one task. Here rows are cut into range
buckets by fixed split points, a window runs inside each bucket, and what has to
cross bucket borders (a last value, an offset) is a one-row-per-bucket table,
which is small by construction and is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulon.schema import ColumnError, fresh_name, ref, require, require_numeric
from tabulon.session import scratch_dir

ROWS_PER_BUCKET = 1_000_000
BROADCAST_VALUES = 500_000
PROBES = 256


def order_value(df: DataFrame, name: str) -> Column:
    """A number that grows with the order column. Ties by rounding are harmless,
    since it only picks the bucket."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return ref(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(ref(name).cast("timestamp")).cast("double")
    raise ColumnError(f"order column {name} must be a number, date or timestamp")


def split_points(df: DataFrame, values: dict[str, Column], rows: dict[str, int], rows_per_bucket: int) -> dict[str, list[float]]:
    """Interior borders of about equally filled ranges; one pass for all values."""
    floor = df.sparkSession.sparkContext.defaultParallelism
    buckets = {c: min(max(math.ceil(n / rows_per_bucket), floor), max(n, 1)) for c, n in rows.items()}
    cut = [c for c in values if buckets[c] > 1]
    if not cut:
        return {c: [] for c in values}
    sketch = lambda c: F.percentile_approx(
        values[c], [i / buckets[c] for i in range(1, buckets[c])], max(10_000, 10 * buckets[c])
    )
    row = df.agg(*[sketch(c).alias(f"c{i}") for i, c in enumerate(cut)]).first()
    found = {c: sorted(set(row[f"c{i}"] or [])) for i, c in enumerate(cut)}
    return {c: found.get(c, []) for c in values}


def with_bucket(df: DataFrame, value: Column, cuts: Sequence[float], out: str) -> DataFrame:
    """Bucket number by binary search over fixed borders: the same in every run."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    key = fresh_name(df, "order_value")
    borders = [-math.inf, *cuts, math.inf]
    search = Bucketizer(splits=borders, inputCol=key, outputCol=out, handleInvalid="keep")
    return search.transform(df.withColumn(key, value)).drop(key)


def range_buckets(df: DataFrame, order_by: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, str]:
    require(df, order_by)
    value = order_value(df, order_by)
    cuts = split_points(df, {order_by: value}, {order_by: df.count()}, rows_per_bucket)[order_by]
    name = fresh_name(df, "bucket")
    return with_bucket(df, value, cuts, name), name


def fill_forward(
    df: DataFrame, columns: Sequence[str], order_by: str, backward: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Carry the last non-null value forward (or the next one backward) in ``order_by`` order."""
    require(df, *columns)
    cut, bucket = range_buckets(df, order_by, rows_per_bucket)
    direction = F.col(bucket).desc() if backward else F.col(bucket).asc()
    order = ref(order_by).desc() if backward else ref(order_by).asc()
    inside = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.min_by if backward else F.max_by
    edges = cut.groupBy(bucket).agg(
        *[edge(ref(c), F.when(ref(c).isNotNull(), ref(order_by))).alias(f"__edge_{i}") for i, c in enumerate(columns)]
    )
    carried = edges.select(
        bucket, *[F.last(f"__edge_{i}", ignorenulls=True).over(earlier).alias(f"__carry_{i}") for i in range(len(columns))]
    )
    within = cut.withColumns({f"__within_{i}": F.last(ref(c), ignorenulls=True).over(inside) for i, c in enumerate(columns)})
    joined = within.join(F.broadcast(carried), bucket, "left")
    filled = {c: F.coalesce(F.col(f"__within_{i}"), F.col(f"__carry_{i}")).alias(c) for i, c in enumerate(columns)}
    return joined.select(*[filled.get(c, ref(c)) for c in df.columns])


def fill_backward(df: DataFrame, columns: Sequence[str], order_by: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    return fill_forward(df, columns, order_by, True, rows_per_bucket)


def interpolate(df: DataFrame, column: str, order_by: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Linear by row position; leading nulls stay, trailing nulls take the last value."""
    require_numeric(df, column)
    cut, bucket = range_buckets(df, order_by, rows_per_bucket)
    x = ref(column).cast("double")
    # Frames that grow from the start cost one step per row; a frame that ends at
    # the last row is evaluated anew for each row, so later rows are read backward.
    by_order = Window.partitionBy(bucket).orderBy(ref(order_by))
    past = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = Window.partitionBy(bucket).orderBy(ref(order_by).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cut.withColumn("__pos", F.row_number().over(by_order).cast("bigint"))
    point = F.when(x.isNotNull(), F.struct(F.col("__pos").alias("pos"), x.alias("value")))

    edges = numbered.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("size"), F.min(point).alias("first"), F.max(point).alias("last")
    )
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = edges.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    shift = lambda p: F.when(p.isNotNull(), F.struct((p["pos"] + F.col("offset")).alias("pos"), p["value"].alias("value")))
    placed = placed.withColumns({"first": shift(F.col("first")), "last": shift(F.col("last"))})
    carried = placed.select(
        bucket,
        F.col("offset").alias("__offset"),
        F.last("last", ignorenulls=True).over(before).alias("__earlier"),
        F.last("first", ignorenulls=True).over(after).alias("__later"),
    )
    local = numbered.withColumns(
        {
            "__prev": F.last(point, ignorenulls=True).over(past),
            "__next": F.last(point, ignorenulls=True).over(future),
        }
    )
    joined = local.join(F.broadcast(carried), bucket, "left")
    here = F.col("__pos") + F.col("__offset")
    prev_pos = F.coalesce(F.col("__prev.pos") + F.col("__offset"), F.col("__earlier.pos"))
    prev_value = F.coalesce(F.col("__prev.value"), F.col("__earlier.value"))
    next_pos = F.coalesce(F.col("__next.pos") + F.col("__offset"), F.col("__later.pos"))
    next_value = F.coalesce(F.col("__next.value"), F.col("__later.value"))
    between = prev_value + (next_value - prev_value) * (here - prev_pos) / (next_pos - prev_pos)
    value = (
        F.when(x.isNotNull(), x)
        .when(prev_pos.isNull(), F.lit(None).cast("double"))
        .when(next_pos.isNull(), prev_value)
        .otherwise(between)
    )
    return joined.select(*[value.alias(c) if c == column else ref(c) for c in df.columns])


@dataclass
class RankTables:
    """Average-tie percentile ranks of the distinct values of several expressions.

    ``table`` has ``name, x, n, before, pct``; ``rows`` counts the non-null rows
    of each name; ``small`` holds the names whose part may be broadcast.
    """

    table: DataFrame | None
    rows: dict[str, int]
    small: set[str]

    def medians(self) -> dict[str, float]:
        """Median of the ranks over all non-null rows."""
        if self.table is None:
            return {}
        middle = F.create_map(*[part for c, n in self.rows.items() if n for part in (F.lit(c), F.array(F.lit((n - 1) // 2), F.lit(n // 2)))])
        at = middle[F.col("name")]
        holds = lambda k: ((F.col("before") <= k) & (k < F.col("before") + F.col("n"))).cast("int")
        picked = self.table.groupBy("name").agg((F.sum(F.col("pct") * (holds(at[0]) + holds(at[1]))) / 2).alias("median"))
        return {row["name"]: row["median"] for row in picked.collect()}


def rank_tables(
    df: DataFrame,
    values: dict[str, Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    broadcast_values: int = BROADCAST_VALUES,
) -> RankTables:
    """Rank the distinct values of several expressions in one pass over the rows.

    Values are counted per (name, range bucket, value), so ties are combined
    before the shuffle and no bucket depends on how often a value occurs. The
    table is written once to the shared folder: every later join reads it back
    by name instead of ranking again.
    """
    names = list(values)
    probes = [i / PROBES for i in range(1, PROBES)]
    measured = df.agg(
        *[F.count(values[c]).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(values[c], 0.05).alias(f"d{i}") for i, c in enumerate(names)],
        *[F.percentile_approx(values[c], probes, 10_000).alias(f"c{i}") for i, c in enumerate(names)],
    ).first()
    rows = {c: measured[f"n{i}"] for i, c in enumerate(names)}
    distinct = {c: measured[f"d{i}"] for i, c in enumerate(names)}
    # the smallest parts may be broadcast, as long as all of them together stay within the bound
    small, held = set(), 0
    for c in sorted(names, key=lambda c: (distinct[c], c)):
        held += distinct[c]
        if held <= broadcast_values:
            small.add(c)
    filled = [c for c in names if rows[c]]
    if not filled:
        return RankTables(None, rows, small)
    cuts = {c: sorted(set(measured[f"c{i}"])) for i, c in enumerate(names) if rows[c]}
    large = {c: values[c] for c in filled if distinct[c] > PROBES * rows_per_bucket}
    cuts |= split_points(df, large, distinct, rows_per_bucket)
    # Adding 0.0 turns -0.0 into 0.0, which the bucket search would tell apart.
    cells = df.select(*[(values[c] + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(filled)])
    search = Bucketizer(
        splitsArray=[[-math.inf, *cuts[c], math.inf] for c in filled],
        inputCols=[f"x{i}" for i in range(len(filled))],
        outputCols=[f"b{i}" for i in range(len(filled))],
        handleInvalid="keep",
    )
    long = search.transform(cells).select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"b{i}").alias("bucket"), F.col(f"x{i}").alias("x")) for i, c in enumerate(filled)])
        )
    )
    counts = long.where("x IS NOT NULL").groupBy("name", "bucket", "x").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("name", "bucket").agg(F.sum("n").alias("size"))
    offsets = sizes.select("name", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    total = F.create_map(*[F.lit(part) for c in filled for part in (c, rows[c])])
    before = F.col("offset") + F.col("upto") - F.col("n")
    ranked = (
        counts.withColumn("upto", F.sum("n").over(Window.partitionBy("name", "bucket").orderBy("x")))
        .join(F.broadcast(offsets), ["name", "bucket"])
        .select("name", "x", "n", before.alias("before"), ((before + (F.col("n") + 1) / 2) / total[F.col("name")]).alias("pct"))
    )
    path = scratch_dir(df.sparkSession, "ranks")
    ranked.write.mode("overwrite").partitionBy("name").parquet(path)
    schema = "x double, n bigint, before bigint, pct double, name string"
    return RankTables(df.sparkSession.read.schema(schema).parquet(path), rows, small)


def with_rank(df: DataFrame, value: Column, ranks: RankTables, name: str, out: str) -> DataFrame:
    """Join the rank of ``value`` to each row; null where the value is null.

    A table too large to broadcast is joined by shuffle, where adaptive execution
    splits the partition of a hot value.
    """
    if not ranks.rows[name]:
        return df.withColumn(out, F.lit(None).cast("double"))
    lookup = ranks.table.where(F.col("name") == name).select(F.col("x").alias(f"__x_{out}"), F.col("pct").alias(out))
    if name in ranks.small:
        lookup = F.broadcast(lookup)
    return df.join(lookup, value == F.col(f"__x_{out}"), "left").drop(f"__x_{out}")


def with_ranks(df: DataFrame, values: dict[str, Column], ranks: RankTables, key: str, out: dict[str, str]) -> DataFrame:
    """Join the ranks of several values at once by a unique key.

    Only (key, name, value) of non-null values meets the rank table; the ranks of a
    row then come back together, so that the wide table is shuffled once, however
    many ranks there are.
    """
    require(df, key)
    named = [F.struct(F.lit(name).alias("name"), (values[name] + F.lit(0.0)).alias("x")) for name in out]
    long = df.select(ref(key).alias("__key"), F.inline(F.array(*named))).where("x IS NOT NULL")
    found = long.join(ranks.table.select("name", "x", "pct"), ["name", "x"])
    wide = found.groupBy("__key").agg(*[F.max(F.when(F.col("name") == name, F.col("pct"))).alias(column) for name, column in out.items()])
    return df.join(wide, ref(key) == F.col("__key"), "left").drop("__key")


def dense_codes(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """``(value, code)``: place of each distinct non-null value in ascending order, from 0.

    The distinct values are written, counted, dealt out by range and written with
    the number of their range, so that places and offsets rest on the same ranges.
    Their number grows with the values. They only balance the tasks; the codes are
    exact for any ranges.
    """
    require(df, column)
    values = df.select(ref(column).alias("value")).where("value IS NOT NULL").distinct()
    spark = df.sparkSession
    distinct, path = scratch_dir(spark, "values"), scratch_dir(spark, "codes")
    values.write.parquet(distinct)
    values = spark.read.schema(values.schema).parquet(distinct)
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(values.count() / ROWS_PER_BUCKET))
    values.repartitionByRange(buckets, "value").withColumn("bucket", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema(f"value {df.schema[column].dataType.simpleString()}, bucket int").parquet(path)
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    coded = cut.withColumn("place", place).join(F.broadcast(offsets), "bucket")
    return coded.select("value", (F.col("offset") + F.col("place") - 1).alias("code"))


def pct_rank(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Average rank of ties divided by the number of non-null values, in (0, 1]."""
    require_numeric(df, column)
    value = ref(column).cast("double")
    return with_rank(df, value, rank_tables(df, {column: value}), column, out or f"{column}_pct")
