"""Queries: summaries, profiles, grouped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import profiling as p
from tabulon.operators import topk
from tabulon.plans.queries.access import NULL_SUM
from tabulon.plans.queries.base import CATEGORICAL, ENTRY_COLUMNS, ENTRY_TYPES_BY_NAME, NUMERIC, Tables, query, rounded, union_all

ALL = list(ENTRY_TYPES_BY_NAME)


@query(
    "summary",
    f"""SELECT count(*) AS total_rows, {len(ALL)} AS total_columns, '{",".join(ALL)}' AS column_names, {len(NUMERIC)} AS numeric_columns,
        {len(CATEGORICAL)} AS categorical_columns, '{",".join(NUMERIC)}' AS numeric_cols, '{",".join(CATEGORICAL)}' AS categorical_cols,
        CAST({NULL_SUM} AS BIGINT) AS total_nulls, round(({NULL_SUM}) * 100.0 / (count(*) * {len(ALL)}), 2) AS null_pct FROM entries""",
)
def _(t: Tables):
    return p.summary(t.entries).withColumns({c: F.array_join(c, ",") for c in ("column_names", "numeric_cols", "categorical_cols")})


_NULLS = "count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS null_pct"


def _numeric_sql(columns, extra: str) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", {_NULLS.format(c=c)}, {extra.format(c=c, dtype=ENTRY_TYPES_BY_NAME[c])} FROM entries""" for c in columns
    )


_STATS = (
    "CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, "
    "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std"
)


@query("profile_numeric", _numeric_sql(NUMERIC, "'{dtype}' AS dtype, count(DISTINCT {c}) AS \"distinct\", " + _STATS))
def _(t: Tables):
    return rounded(p.profile_numeric(t.entries), 4, "mean", "median", "std")


@query(
    "profile_categorical",
    union_all(
        f"""SELECT '{c}' AS "column", '{ENTRY_TYPES_BY_NAME[c]}' AS dtype, {_NULLS.format(c=c)}, count(DISTINCT {c}) AS "distinct",
            (SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM entries
             WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) AS top_values FROM entries"""
        for c in CATEGORICAL
    ),
)
def _(t: Tables):
    pairs = F.transform(F.map_entries("top_values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.profile_categorical(t.entries).withColumn("top_values", F.array_join(pairs, "|"))


@query("profile_columns")
def _(t: Tables):
    return p.profile_columns(t.lineitem)


@query("profile_approx")
def _(t: Tables):
    return p.profile_numeric(t.lineitem, approx=True).select("column", "nulls", "distinct", "min", "max")


TOP = ["region", "ai_technique", "nexus_focus", "status", "organization"]


def _top_sql(c: str, k) -> str:
    return f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
        CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank FROM entries WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}"""


@query("top_values", union_all(_top_sql(c, 5) for c in TOP))
def _(t: Tables):
    return topk.top_values(t.entries, TOP, 5)


@query("top_groups", "SELECT organization, count(*) AS count FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(t: Tables):
    return topk.top_groups(t.entries, "organization", 12)


@query(
    "top_per_group",
    """SELECT region, ai_technique, n, CAST(row_number() OVER (PARTITION BY region ORDER BY n DESC, ai_technique) AS INT) AS rank
       FROM (SELECT region, ai_technique, count(*) AS n FROM entries GROUP BY ALL) QUALIFY rank <= 3""",
)
def _(t: Tables):
    counts = t.entries.groupBy("region", "ai_technique").agg(F.count(F.lit(1)).alias("n"))
    return topk.top_per_group(counts, ["region"], [F.desc("n"), F.col("ai_technique")], 3)


@query(
    "semi_top_groups",
    """SELECT row_id, organization FROM entries WHERE organization IN
       (SELECT organization FROM entries GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6)""",
)
def _(t: Tables):
    return topk.in_top_groups(t.entries.select("row_id", "organization"), "organization", 6)


@query(
    "distribution",
    """SELECT coalesce(nexus_focus, 'nan') AS value, count(*) AS count FROM entries GROUP BY nexus_focus
       ORDER BY 2 DESC, nexus_focus NULLS LAST LIMIT 50""",
)
def _(t: Tables):
    return p.distribution(t.entries, "nexus_focus")


@query(
    "distribution_many",
    """SELECT coalesce(CAST(user_id AS VARCHAR), 'nan') AS value, count(*) AS count FROM events GROUP BY user_id
       ORDER BY 2 DESC, user_id LIMIT 50""",
)
def _(t: Tables):
    return p.distribution(t.events, "user_id")


@query("temporal", "SELECT year, count(*) AS count FROM entries GROUP BY 1")
def _(t: Tables):
    return p.temporal(t.entries)


@query("temporal_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1")
def _(t: Tables):
    return p.temporal(t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day")), "day")


@query(
    "funding_by_year",
    """SELECT CAST(year AS BIGINT) AS year, round(sum(funding_usd), 2) AS total_funding, round(avg(funding_usd), 2) AS average_funding, count(*) AS count,
       round(sum(funding_usd) / 1e6, 2) AS total_funding_m, round(avg(funding_usd) / 1e6, 2) AS average_funding_m
       FROM entries WHERE funding_usd IS NOT NULL AND year IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return rounded(p.funding_by_period(t.entries), 2)


def _breakdown(columns, lo: int, hi: int, k: int) -> str:
    return union_all(f"SELECT * FROM ({_top_sql(c, k)}) WHERE (SELECT count(DISTINCT {c}) FROM entries) BETWEEN {lo} AND {hi}" for c in columns)


@query("breakdown_geographic", _breakdown(CATEGORICAL[:8], 2, 80, 20))
def _(t: Tables):
    return p.categorical_breakdown(t.entries)


@query("breakdown_techniques", _breakdown(CATEGORICAL, 3, 60, 60))
def _(t: Tables):
    return p.categorical_breakdown(t.entries, len(CATEGORICAL), 3, 60, None)


_OVERVIEW = (
    "round(sum(CAST({c} AS DOUBLE)), 2) AS total, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, "
    "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    "round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std"
)


@query("numeric_overview", _numeric_sql([c for c in NUMERIC[:12]], _OVERVIEW))
def _(t: Tables):
    return rounded(rounded(p.numeric_overview(t.entries), 4, "mean", "median", "std"), 2, "total")


@query(
    "null_report",
    "SELECT * FROM ("
    + union_all(f"""SELECT '{c}' AS "column", '{k}' AS dtype, {_NULLS.format(c=c)} FROM entries""" for c, k in ENTRY_COLUMNS)
    + ") WHERE null_pct > 0",
)
def _(t: Tables):
    return p.null_report(t.entries)


@query(
    "column_health",
    "SELECT *, CASE WHEN null_pct = 0 THEN 'ok' WHEN null_pct < 10 THEN 'warn' ELSE 'bad' END AS health FROM ("
    + union_all(f"""SELECT '{c}' AS "column", '{k}' AS dtype, {_NULLS.format(c=c)} FROM entries""" for c, k in ENTRY_COLUMNS)
    + ")",
)
def _(t: Tables):
    return p.column_health(t.entries)


@query(
    "kpis",
    f"""SELECT count(*) AS total_rows, {len(CATEGORICAL)} AS categorical_columns, {len(NUMERIC)} AS numeric_columns,
        round(avg(funding_usd), 2) AS avg_funding_usd, round(avg(impact_score), 4) AS avg_impact_score FROM entries""",
)
def _(t: Tables):
    return rounded(rounded(p.kpis(t.entries), 2, "avg_funding_usd"), 4, "avg_impact_score")
