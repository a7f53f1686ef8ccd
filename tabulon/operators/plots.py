"""Grouped statistics behind plots: histogram, box plot, density, correlation, radar."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.coerce import number_of
from tabulon.operators.quantiles import group_quantiles
from tabulon.operators.topk import complete_top
from tabulon.schema import ref, numeric_columns, require, require_numeric


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins included."""
    require_numeric(df, column)
    if bins < 1:
        raise ValueError("bins must be positive")
    values = df.select(number_of(df, column).alias("x")).dropna()
    row = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = (0.0, 1.0) if row["lo"] is None else (row["lo"], row["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    edge = lambda i: F.when(i == bins, F.lit(hi)).otherwise(i * F.lit(width) + F.lit(lo))
    guess = F.least(F.floor((F.col("x") - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    g = F.col("guess")
    # Division can be off by one ulp: the edges decide.
    place = F.when(F.col("x") < edge(g), g - 1).when((F.col("x") >= edge(g + 1)) & (g < bins - 1), g + 1).otherwise(g)
    counts = values.withColumn("guess", guess).groupBy(place.alias("bin")).count()
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(F.broadcast(counts), "bin", "left")
        .select("bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("bin")
    )


def _fences(df: DataFrame, column: str, group: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the top groups with their quartiles and fences; the quartile side
    has at most k rows."""
    require_numeric(df, column)
    rows, top = complete_top(df, group, [column], k)
    quartiles = group_quantiles(rows, group, column, [0.25, 0.5, 0.75], sum(n for _, n in top))
    spread = quartiles.select(
        ref(group), *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]
    ).withColumns(
        {
            "lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    return rows.withColumn(column, ref(column).cast("double")), spread


def boxplot(df: DataFrame, column: str, group: str, k: int = 12) -> DataFrame:
    """Quartiles, whiskers and outlier count of the k largest groups with 2 or more rows."""
    rows, spread = _fences(df, column, group, k)
    x = ref(column)
    inside = (x >= F.col("lower")) & (x <= F.col("upper"))
    return (
        rows.join(F.broadcast(spread), group)
        .groupBy(ref(group).cast("string").alias("group"), "q1", "q2", "q3", "lower", "upper")
        .agg(
            F.min(F.when(inside, x)).alias("low"),
            F.max(F.when(inside, x)).alias("high"),
            F.count_if(~inside).alias("n_outliers"),
            F.count(F.lit(1)).alias("count"),
        )
        .where("count >= 2")
        .select(
            "group",
            "q1",
            "q2",
            "q3",
            F.coalesce("low", "lower").alias("whisker_low"),
            F.coalesce("high", "upper").alias("whisker_high"),
            "n_outliers",
            "count",
        )
        .orderBy(F.desc("count"), "group")
    )


def boxplot_outliers(df: DataFrame, column: str, group: str, k: int = 12) -> DataFrame:
    """One row per value outside the fences of its group, as a table of any size."""
    rows, spread = _fences(df, column, group, k)
    x = ref(column)
    return (
        rows.join(F.broadcast(spread), group)
        .where((x < F.col("lower")) | (x > F.col("upper")))
        .select(ref(group).cast("string").alias("group"), x.alias("value"))
    )


def kde_bandwidth(df: DataFrame, column: str, group: str, k: int = 6) -> DataFrame:
    """Rule-of-thumb bandwidth of the k largest groups."""
    return _bandwidths(*_kde_rows(df, column, group, k))


def _kde_rows(df: DataFrame, column: str, group: str, k: int) -> tuple[DataFrame, list[tuple]]:
    require_numeric(df, column)
    rows, top = complete_top(df, group, [column], k)
    return rows.select(ref(group).alias("group"), ref(column).cast("double").alias("x")), top


def _bandwidths(rows: DataFrame, top: list[tuple]) -> DataFrame:
    quartiles = group_quantiles(rows, "group", "x", [0.25, 0.75], sum(n for _, n in top))
    stats = rows.groupBy("group").agg(
        F.count("x").alias("count"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("std")
    )
    rule = 0.9 * F.least(F.col("std"), (F.col("q")[1] - F.col("q")[0]) / 1.34) * F.pow(F.col("count"), F.lit(-0.2))
    flat = F.when(F.col("hi") > F.col("lo"), 0.1 * (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return (
        stats.join(F.broadcast(quartiles), "group")
        .withColumn("rule", rule)
        .select("group", "count", "lo", "hi", F.when(F.col("rule") == 0, flat).otherwise(F.col("rule")).alias("bandwidth"))
    )


#: Beyond so many bandwidths exp(-d * d / 2) is 0 in double precision.
REACH = 38.61


def kernel_terms(rows: DataFrame, bands: DataFrame, grid: int) -> DataFrame:
    """Each value (``group``, ``x``, ``times``) beside the grid points (``point``, ``at``) that its
    kernel reaches, found by index arithmetic on the equidistant grid of its group."""
    near = rows.join(F.broadcast(bands), "group")
    place = lambda offset: F.least(F.greatest((F.col("x") + offset - F.col("start")) / F.col("step"), F.lit(-1.0)), F.lit(grid + 0.0))
    reach = F.col("bandwidth") * REACH
    # a point more on either side, where division is off by rounding
    first = F.greatest(F.ceil(place(-reach)) - 1, F.lit(0))
    last = F.least(F.floor(place(reach)) + 1, F.lit(grid - 1))
    reached = near.withColumn("point", F.explode(F.sequence(first, last)))
    return reached.withColumn("at", F.col("start") + F.col("point") * F.col("step"))


def density(df: DataFrame, column: str, group: str, k: int = 6, grid: int = 100) -> DataFrame:
    """Gaussian kernel density of the k largest groups on a grid; sums to 1 per group.

    A value meets only the grid points that its kernel reaches, inside the map tasks:
    k*grid partial sums at most leave them. Repeated values are counted first where
    that saves most of the work.
    """
    rows, top = _kde_rows(df, column, group, k)
    bands = _bandwidths(rows, top).where("count >= 3")
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.1).otherwise(1.0)
    bands = (
        bands.withColumn("pad", pad)
        .withColumn("start", F.col("lo") - F.col("pad"))
        .withColumn("step", (F.col("hi") + F.col("pad") - F.col("start")) / F.lit(max(grid - 1, 1)))
        .select("group", "count", "bandwidth", "start", "step")
    )
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64("group", "x"))).first()[0]
    if distinct * 8 <= sum(n for _, n in top):
        rows = rows.groupBy("group", "x").agg(F.count(F.lit(1)).alias("times"))
    else:
        rows = rows.withColumn("times", F.lit(1))
    terms = kernel_terms(rows, bands, grid)
    distance = (F.col("at") - F.col("x")) / F.col("bandwidth")
    sums = terms.groupBy("group", "point").agg(F.sum(F.col("times") * F.exp(-0.5 * distance * distance)).alias("weight"))
    points = bands.withColumn("point", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))))
    # points that no kernel reaches have no sum
    weights = points.join(F.broadcast(sums), ["group", "point"], "left").select(
        "group", "point", "count", (F.col("start") + F.col("point") * F.col("step")).alias("at"), F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    total = sums.groupBy("group").agg(F.sum("weight").alias("total"))
    share = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.col("weight"))
    return (
        weights.join(F.broadcast(total), "group")
        .select(F.col("group").cast("string").alias("group"), F.col("point").cast("int").alias("point"), F.col("at").alias("x"), share.alias("density"), "count")
        .orderBy("group", "point")
    )


def scatter(df: DataFrame, x: str, y: str, order_by: str, color: str | None = None, limit: int = 2000) -> DataFrame:
    """First complete points in ``order_by`` order; the limit is the feature."""
    require(df, x, y, order_by)
    out = {"x": number_of(df, x), "y": number_of(df, y)}
    if color in df.columns:
        out["color"] = ref(color).cast("string")
    return _first_complete(df, out, order_by, limit)


def parallel_coords(df: DataFrame, dims: Sequence[str], order_by: str, color: str | None = None, limit: int = 500) -> DataFrame:
    """First complete rows over several numeric dimensions."""
    require(df, *dims, order_by)
    out = {c: number_of(df, c) for c in dims}
    if color in df.columns:
        out["color"] = ref(color).cast("string")
    return _first_complete(df, out, order_by, limit)


def _first_complete(df: DataFrame, out: dict[str, Column], order_by: str, limit: int) -> DataFrame:
    return (
        df.select(ref(order_by).alias("__order"), *[value.alias(name) for name, value in out.items()])
        .dropna(subset=list(out))
        .orderBy("__order")
        .limit(limit)
        .drop("__order")
    )


def radar(df: DataFrame, group: str, metrics: Sequence[str], k: int = 8) -> DataFrame:
    """Mean of each metric in the k largest groups of the complete cases."""
    require_numeric(df, *metrics)
    rows, _ = complete_top(df, group, metrics, k)
    return (
        rows.groupBy(ref(group).cast("string").alias("group"))
        .agg(F.count(F.lit(1)).alias("count"), *[F.avg(ref(m)).alias(m) for m in metrics])
        .orderBy(F.desc("count"), "group")
    )


def _pair_sums() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task function. As an inner function it travels by value, so the workers
    need numpy and pyarrow but not this package."""

    def sums_of_pairs(batches):
        # Sums over the rows where both columns of a pair are present, for all
        # pairs at once; one row per pair leaves the task.
        total = None
        for batch in batches:
            x = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            here = (~np.isnan(x)).astype(float)
            x = np.where(here > 0, x, 0.0)
            sums = np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            n, s, ss, cross = total
            i, j = np.triu_indices(len(n), 1)
            parts = [n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], cross[i, j]]
            arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, parts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *PAIR_SUMS])

    return sums_of_pairs


PAIR_SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]
# Below this share of the raw second moment a variance may be a rounding error.
DOUBTFUL = 1e-9


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each column pair over the rows where both are present.

    The sums of all pairs come from one pass with matrix products in the tasks:
    three built-in aggregates per pair took 14 times as long for 120 pairs.
    Pairs whose variance is near the rounding error are measured again with the
    built-in aggregates. Undefined (constant) pairs are null, columns without
    values are left out. The result is as small as the number of pairs.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    require_numeric(df, *names)
    spark = df.sparkSession
    schema = "x string, y string, value double"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    cells = df.select(*[number_of(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    means = cells.agg(*[F.avg(c) for c in cells.columns]).first()
    kept = [i for i, m in enumerate(means) if m is not None]
    if len(kept) < 2:
        return spark.createDataFrame([], schema)
    centred = cells.select(*[(F.col(f"c{i}") - F.lit(means[i])).alias(f"c{i}") for i in kept])
    sums = centred.mapInArrow(_pair_sums(), "i int, j int, " + ", ".join(f"{k} double" for k in PAIR_SUMS))
    rows = sums.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in PAIR_SUMS]).collect()
    values: dict[tuple[int, int], float | None] = {}
    again = []
    for row in rows:
        pair, n = (kept[row["i"]], kept[row["j"]]), row["n"]
        if n < 2:
            values[pair] = None
            continue
        a, b = row["saa"] - row["sa"] ** 2 / n, row["sbb"] - row["sb"] ** 2 / n
        if a <= DOUBTFUL * row["saa"] or b <= DOUBTFUL * row["sbb"]:
            again.append(pair)
        else:
            values[pair] = (row["sab"] - row["sa"] * row["sb"] / n) / (math.sqrt(a) * math.sqrt(b))
    values |= _measured_again(cells, again)
    found = [(names[i], names[j], v) for (i, j), v in sorted(values.items())]
    return spark.createDataFrame(found, schema).withColumn("value", F.round("value", 3))


def _measured_again(cells: DataFrame, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float | None]:
    if not pairs:
        return {}
    aggregates = []
    for k, (i, j) in enumerate(pairs):
        a, b = F.col(f"c{i}"), F.col(f"c{j}")
        spread = F.stddev_samp(F.when(b.isNotNull(), a)) * F.stddev_samp(F.when(a.isNotNull(), b))
        aggregates.append(F.try_divide(F.covar_samp(a, b), spread).alias(f"r{k}"))
    row = cells.agg(*aggregates).first()
    return {pair: row[f"r{k}"] for k, pair in enumerate(pairs)}


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both triangles and the unit diagonal, in long form."""
    upper = correlation(df, columns)
    cells = F.array(F.struct("x", "y", "value"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    both = upper.select(F.inline(cells))
    names = upper.select(F.explode(F.array("x", "y")).alias("x")).distinct()
    return both.unionByName(names.select("x", F.col("x").alias("y"), F.lit(1.0).alias("value")))
