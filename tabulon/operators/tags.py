"""Several tags in one text cell: extraction, co-occurrence, outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.coerce import number_of, strip
from tabulon.operators.pivots import crosstab
from tabulon.operators.topk import in_top_groups
from tabulon.schema import ref, require

# The shape of a tag, the label of a row without one, the outcome measures.
TAG = r"SDG\s*\d+"
OTHER = "Other"
OUTCOMES = {
    "project_value_score": "avg_project_value_score",
    "resource_efficiency_score": "avg_resource_efficiency_score",
    "funding_usd": "avg_funding",
    "co2_reduction_tons": "avg_co2_reduction",
    "impact_score": "avg_impact",
}


def tag_list(column: str, pattern: str = TAG) -> Column:
    """All matches in order, repeats kept; an empty array for null."""
    text = F.coalesce(strip(ref(column).cast("string")), F.lit(""))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_tags(df: DataFrame, column: str, out: str = "tags", pattern: str = TAG) -> DataFrame:
    require(df, column)
    return df.withColumn(out, tag_list(column, pattern))


def distinct_tags(df: DataFrame, column: str, pattern: str = TAG) -> DataFrame:
    require(df, column)
    return df.select(F.explode(tag_list(column, pattern)).alias("tag")).distinct().orderBy("tag")


def primary_tag(column: str, pattern: str = TAG) -> Column:
    return F.coalesce(F.get(tag_list(column, pattern), 0), F.lit(OTHER))


def tag_pairs(df: DataFrame, column: str, pattern: str = TAG) -> DataFrame:
    """Rows per unordered tag pair. Pairs are formed inside a row, whose tags are
    few, and are counted before the shuffle."""
    require(df, column)
    tags = df.select(F.array_sort(F.array_distinct(tag_list(column, pattern))).alias("tags"))
    return (
        tags.where(F.size("tags") > 1)
        .select("tags", F.explode("tags").alias("tag_a"))
        .select("tag_a", F.explode(F.filter("tags", lambda t: t > F.col("tag_a"))).alias("tag_b"))
        .groupBy("tag_a", "tag_b")
        .count()
    )


def tag_jaccard(df: DataFrame, column: str, pattern: str = TAG) -> DataFrame:
    """Rows with both tags over rows with either, per pair that occurs."""
    rows = (
        df.select(F.explode(F.array_distinct(tag_list(column, pattern))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    )
    a = rows.select(F.col("tag").alias("tag_a"), F.col("n").alias("n_a"))
    b = rows.select(F.col("tag").alias("tag_b"), F.col("n").alias("n_b"))
    return (
        tag_pairs(df, column, pattern)
        .join(a, "tag_a")
        .join(b, "tag_b")
        .select(
            F.concat_ws(" + ", "tag_a", "tag_b").alias("pair"),
            "tag_a",
            "tag_b",
            "count",
            F.round(F.col("count") / (F.col("n_a") + F.col("n_b") - F.col("count")), 4).alias("jaccard"),
        )
    )


def tag_shares(df: DataFrame, group: str, column: str, tags: Sequence[str] = ("SDG 6", "SDG 7"), k: int = 15) -> DataFrame:
    """Share of rows whose text contains each tag, for the k largest groups.

    The test is a literal substring, so ``SDG 6`` also finds ``SDG 60``.
    """
    require(df, group, column)
    name = lambda tag: tag.lower().replace(" ", "") + "_share"
    text = F.coalesce(ref(column).cast("string"), F.lit(""))
    return (
        in_top_groups(df.select(ref(group), text.alias("__text")), group, k)
        .groupBy(ref(group).alias("technique"))
        .agg(*[F.round(F.avg(F.col("__text").contains(tag).cast("int")), 4).alias(name(tag)) for tag in tags])
    )


def _exploded(df: DataFrame, column: str, pattern: str) -> DataFrame:
    tags = tag_list(column, pattern)
    return df.withColumn("tag", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(OTHER)))))


def tag_outcomes(df: DataFrame, column: str, measures: Mapping[str, str] = OUTCOMES, pattern: str = TAG) -> DataFrame:
    """Entries and mean measures per tag; a repeated tag counts again. Funding in
    millions; measures without values give 0."""
    require(df, column)

    def mean(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        value = F.avg(number_of(df, name))
        value = value / 1e6 if name == "funding_usd" else value
        return F.coalesce(F.round(value, 2), F.lit(0.0))

    return (
        _exploded(df, column, pattern)
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("entries"), *[mean(c).alias(out) for c, out in measures.items()])
        .orderBy(F.desc("entries"), "tag")
    )


def tag_synergy(df: DataFrame, column: str, impact: str = "impact_score", efficiency: str = "resource_efficiency_score", pattern: str = TAG) -> DataFrame:
    """Rows with one tag against rows with several; rows without tags are left out."""
    require(df, column)
    mean = lambda c: F.round(F.avg(number_of(df, c)), 2) if c in df.columns else F.lit(0.0)
    n = F.size(tag_list(column, pattern))
    return (
        df.withColumn("group", F.when(n == 1, "Single Goal").when(n > 1, "Multi-Goal (Synergy)"))
        .where(F.col("group").isNotNull())
        .groupBy("group")
        .agg(mean(impact).alias("avg_impact"), mean(efficiency).alias("avg_resource_efficiency"), F.count(F.lit(1)).alias("count"))
    )


def tag_heatmap(df: DataFrame, group: str, column: str, min_share: float = 0.01, pattern: str = TAG) -> DataFrame:
    """Counts and shares of tags within each group."""
    require(df, group, column)
    return crosstab(_exploded(df.select(ref(group), ref(column)), column, pattern), group, "tag", min_share)
