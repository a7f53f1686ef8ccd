"""Exact quantiles with linear interpolation, without collecting a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in the memory of
one task. That is the fastest form while the values of all groups together stay
under ``SINGLE_PASS_VALUES``. Beyond it, the wanted ranks are narrowed down: each
pass counts the rows below, at and between two bounds (a map-side aggregate with
a tiny state) and reads tighter bounds from an approximate sketch, until so few
rows lie strictly between them that these can be ranked directly. Counts decide,
the sketch only steers, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.coerce import finite
from tabulon.schema import ref, require_numeric

SINGLE_PASS_VALUES = 4_000_000
RANKED_VALUES = 1_000_000
STEPS = 500


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    single_pass_values: int = SINGLE_PASS_VALUES,
    rows: int | None = None,
) -> dict[str, list[float] | None]:
    """Quantiles of whole columns; None for a column without values.

    ``rows`` is an upper bound of the row count, when the caller knows one.
    """
    require_numeric(df, *columns)
    columns = list(columns)
    if not columns:
        return {}
    rows = df.count() if rows is None else rows
    if rows * len(columns) <= single_pass_values:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(
            *[F.percentile(finite(ref(c).cast("double")), wanted).alias(f"q{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: row[f"q{i}"] for i, c in enumerate(columns)}
    values = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("key"), finite(ref(c).cast("double")).alias("x")) for c in columns])
        )
    ).where(F.col("x").isNotNull())
    found = _interpolated(values, probs)
    return {c: found.get(c) for c in columns}


def column_median(df: DataFrame, columns: Sequence[str], **kw) -> dict[str, float | None]:
    found = column_quantiles(df, columns, [0.5], **kw)
    return {c: (q[0] if q else None) for c, q in found.items()}


def group_quantiles(
    df: DataFrame,
    by: str,
    x: str,
    probs: Sequence[float],
    rows: int,
    single_pass_values: int = SINGLE_PASS_VALUES,
) -> DataFrame:
    """One row ``(by, q)`` per group, ``q`` an array in the order of ``probs``.

    For a bounded number of groups (a top-k set). ``rows`` is their row total.
    """
    value = finite(ref(x).cast("double"))
    if rows <= single_pass_values:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(ref(by).alias(by)).agg(F.percentile(value, wanted).alias("q"))
    values = df.select(ref(by).alias("key"), value.alias("x")).dropna()
    found = _interpolated(values, probs)
    schema = f"`{by}` {df.schema[by].dataType.simpleString()}, q array<double>"
    return df.sparkSession.createDataFrame(list(found.items()), schema)


def _interpolated(values: DataFrame, probs: Sequence[float], ranked_values: int = RANKED_VALUES) -> dict:
    sizes = {
        r["key"]: (r["n"], r["lo"], r["hi"])
        for r in values.groupBy("key").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    }
    ranks = {
        key: sorted({math.floor(p * (n - 1)) for p in probs} | {math.ceil(p * (n - 1)) for p in probs})
        for key, (n, _, _) in sizes.items()
    }
    found = _select_ranks(values, sizes, ranks, ranked_values)
    out = {}
    for key, (n, _, _) in sizes.items():
        row = []
        for p in probs:
            place = p * (n - 1)
            under, over = math.floor(place), math.ceil(place)
            low, high = found[key, under], found[key, over]
            # The weights of Spark's own percentile, so that both paths agree.
            row.append(low if under == over else (over - place) * low + (place - under) * high)
        out[key] = row
    return out


def _select_ranks(values: DataFrame, sizes: dict, ranks: dict, ranked_values: int) -> dict:
    """The value at each 0-based rank of each key.

    Every open target has an interval of values that holds it; targets with the
    same interval share its counts and its sketch.
    """
    inside = (F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi"))
    open_targets = {(key, r): sizes[key][1:] for key, rs in ranks.items() for r in rs}
    found: dict = {}
    last: dict = {}
    while open_targets:
        intervals = sorted({(key, *bounds) for (key, _), bounds in open_targets.items()}, key=repr)
        rows = (
            _with_intervals(values, intervals)
            .groupBy("id")
            .agg(
                F.count_if(F.col("x") < F.col("lo")).alias("below"),
                F.count_if(F.col("x") == F.col("lo")).alias("at_lo"),
                F.count_if(inside).alias("inside"),
                F.count_if(F.col("x") == F.col("hi")).alias("at_hi"),
                F.percentile_approx(F.when(inside, F.col("x")), [i / STEPS for i in range(STEPS + 1)], 10 * STEPS).alias("cuts"),
            )
            .collect()
        )
        counted = {intervals[row["id"]]: row for row in rows}
        still_open = {}
        for (key, rank), (lo, hi) in open_targets.items():
            row = counted[key, lo, hi]
            start = row["below"] + row["at_lo"]
            if rank < row["below"]:
                still_open[key, rank] = (sizes[key][1], lo)
            elif rank < start:
                found[key, rank] = lo
            elif rank < start + row["inside"]:
                if row["inside"] <= ranked_values:
                    last[key, rank] = (lo, hi, rank - start)
                else:
                    cuts = [lo, *row["cuts"], hi]
                    at = 1 + math.floor((rank - start) / row["inside"] * STEPS)
                    still_open[key, rank] = (cuts[max(at - 1, 0)], cuts[min(at + 2, len(cuts) - 1)])
            elif rank < start + row["inside"] + row["at_hi"]:
                found[key, rank] = hi
            else:
                still_open[key, rank] = (hi, sizes[key][2])
        open_targets = still_open
    if last:
        found.update(_rank_directly(values, last, inside))
    return found


def _with_intervals(values: DataFrame, intervals: list[tuple]) -> DataFrame:
    """Each value with every interval of its key; a few intervals per key."""
    key_type = values.schema["key"].dataType.simpleString()
    rows = [(i, *interval) for i, interval in enumerate(intervals)]
    bounds = values.sparkSession.createDataFrame(rows, f"id int, key {key_type}, lo double, hi double")
    return values.join(F.broadcast(bounds), "key")


def _rank_directly(values: DataFrame, targets: dict, inside: Column) -> dict:
    """Ranks among the few rows strictly inside each interval; these were counted."""
    intervals = sorted({(key, lo, hi) for (key, _), (lo, hi, _) in targets.items()}, key=repr)
    ids = {interval: i for i, interval in enumerate(intervals)}
    places: dict = {}
    for (key, rank), (lo, hi, place) in targets.items():
        places.setdefault(ids[key, lo, hi], []).append((place, key, rank))
    wanted = F.create_map(*[part for i, items in places.items() for part in (F.lit(i), F.array(*[F.lit(p) for p, _, _ in items]))])
    picked = (
        _with_intervals(values, intervals)
        .where(inside)
        .groupBy("id", "x")
        .count()
        .withColumn("upto", F.sum("count").over(Window.partitionBy("id").orderBy("x")))
        .withColumn("from", F.col("upto") - F.col("count"))
        .where(F.exists(wanted[F.col("id")], lambda p: (p >= F.col("from")) & (p < F.col("upto"))))
    )
    found = {}
    for row in picked.collect():
        for place, key, rank in places[row["id"]]:
            if row["from"] <= place < row["upto"]:
                found[key, rank] = row["x"]
    return found
