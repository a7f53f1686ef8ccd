"""Domain reports: adoption trends and grouped insight tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.coerce import number_of, strip
from tabulon.operators.pivots import pair_counts, pivot_counts
from tabulon.operators.quantiles import column_median
from tabulon.operators.topk import top_groups
from tabulon.schema import is_numeric, ref, require

# Ordered stress levels, entry types and what counts as open access.
STRESS_LEVELS = ["Low", "Low-Medium", "Medium-High", "High", "Extremely High"]
ENTRY_TYPES = ["Publication", "Project", "Patent", "Policy"]
OPEN_ACCESS = ["yes", "green oa", "gold oa"]


def trend(df: DataFrame, time: str = "year", group: str = "ai_technique") -> DataFrame:
    """Rows per (time, group) and their share of the period."""
    return pair_counts(df, time, group).orderBy(ref(time), F.desc("count"), ref(group))


def trend_summary(df: DataFrame, time: str = "year", group: str = "ai_technique", k: int = 5) -> DataFrame:
    """One row: number of pairs, periods covered, distinct groups, top groups."""
    pairs = pair_counts(df, time, group).select(ref(time).alias("period"), ref(group).alias("member"), "count")
    top = (
        pairs.groupBy("member")
        .agg(F.sum("count").alias("total"))
        .orderBy(F.desc("total"), "member")
        .limit(k)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("n"), "member"))).alias("ranked"))
        .select(F.col("ranked.member").alias("top_groups"), F.lit(1).alias("one"))
    )
    sizes = pairs.groupBy("period").agg(F.count(F.lit(1)).alias("pairs"))
    periods = sizes.agg(
        F.sum("pairs").alias("total_rows"), F.array_sort(F.collect_list("period")).alias("periods"), F.lit(1).alias("one")
    )
    members = pairs.agg(F.count_distinct("member").alias("unique_groups"), F.lit(1).alias("one"))
    return periods.join(members, "one").join(top, "one").select("total_rows", "periods", "unique_groups", "top_groups")


def _measure(df: DataFrame, name: str, missing: float | None) -> Column:
    """Numeric column with nulls replaced; the constant where the column is absent."""
    if name not in df.columns:
        return F.lit(missing).cast("double")
    return F.coalesce(number_of(df, name), F.lit(missing).cast("double"))


def group_means(
    df: DataFrame, group: str, measures: dict[str, str], missing: dict[str, float | None], digits: int = 2
) -> DataFrame:
    """Mean per group of measures (output name to column) after filling nulls; with count."""
    require(df, group)
    rows = df.where(ref(group).isNotNull())
    means = [F.round(F.avg(_measure(df, c, missing.get(c))), digits).alias(out) for out, c in measures.items()]
    return rows.groupBy(ref(group).alias(group)).agg(*means, F.count(F.lit(1)).alias("count"))


def collaboration_performance(df: DataFrame, group: str = "collaboration_type") -> DataFrame:
    """Mean impact and return per form of collaboration, nulls as the column median."""
    columns = ["impact_score", "investment_roi"]
    numbers = df.select(*[number_of(df, c).alias(c) for c in columns])
    medians = column_median(numbers, columns)
    return group_means(df, group, {"avg_impact": columns[0], "avg_roi": columns[1]}, medians).orderBy(ref(group))


def stress_by_technique(
    df: DataFrame,
    stress: str = "water_stress_level",
    technique: str = "ai_technique",
    levels: Sequence[str] = tuple(STRESS_LEVELS),
    k: int = 6,
) -> DataFrame:
    top = [row[technique] for row in top_groups(df, technique, k).collect()]
    return pivot_counts(df, stress, technique, top, levels)


def entry_types_by_year(df: DataFrame, time: str = "year", kind: str = "entry_type", kinds: Sequence[str] = tuple(ENTRY_TYPES)) -> DataFrame:
    return pivot_counts(df, time, kind, list(kinds))


def regional_policy(df: DataFrame, region: str = "region", stringency: str = "policy_stringency_score", access: str = "open_access") -> DataFrame:
    """Mean stringency (null as 0) and percentage of open entries per region."""
    require(df, region)
    is_open = F.lit(False)
    if access in df.columns:
        is_open = F.coalesce(F.lower(strip(ref(access).cast("string"))).isin(OPEN_ACCESS), F.lit(False))
    return (
        df.where(ref(region).isNotNull())
        .groupBy(ref(region).alias(region))
        .agg(
            F.round(F.avg(_measure(df, stringency, 0.0)), 2).alias("avg_policy_stringency"),
            F.round(F.avg(is_open.cast("int")) * 100, 2).alias("open_access_rate"),
            F.count(F.lit(1)).alias("count"),
        )
        .orderBy(ref(region))
    )


def resource_savings(df: DataFrame, group: str = "ai_technique") -> DataFrame:
    """Mean savings per technique with nulls as 0, most frequent first."""
    measures = {
        "avg_co2_reduction": "co2_reduction_tons",
        "avg_water_savings": "water_savings_liters",
        "avg_energy_savings": "energy_savings_kwh",
    }
    out = group_means(df, group, measures, {c: 0.0 for c in measures.values()})
    return out.orderBy(F.desc("count"), ref(group))
