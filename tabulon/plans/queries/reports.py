"""Queries: scores, trends, pivots, insight tables and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabulon.operators import pivots, reports, tags
from tabulon.operators.scores import DEFAULT_SCORES, Mapped, Ranked, STATUS_SCORES, weighted_scores, with_components
from tabulon.plans.queries.base import Tables, query, rounded

# ---- scores -----------------------------------------------------------------


def pct_sql(component: Ranked) -> str:
    """Rank component as SQL over ``entries``; nulls get the median rank."""
    x = f"CAST({component.column} AS DOUBLE)"
    if component.log:
        x = f"ln(1e0 + greatest({x}, 0e0))"
    # Ranks depend on the order only, so the logarithm may differ in its last digit.
    return f"""(SELECT row_id, coalesce(pct, (SELECT median(pct) FROM (SELECT (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0) / count(x) OVER () AS pct
        FROM (SELECT CASE WHEN {component.column} IS NOT NULL THEN {x} END AS x FROM entries) WHERE x IS NOT NULL))) AS v FROM (
        SELECT row_id, CASE WHEN x IS NOT NULL THEN (rank() OVER (ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY x) - 1) / 2e0) / count(x) OVER () END AS pct
        FROM (SELECT row_id, CASE WHEN {component.column} IS NOT NULL THEN {x} END AS x FROM entries)))"""


def mapped_sql(component: Mapped) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in component.table.items())
    return f"(SELECT row_id, CASE lower(trim(coalesce({component.column}, ''))) {cases} ELSE {component.default}e0 END AS v FROM entries)"


def score_ctes(name: str) -> tuple[str, str]:
    """CTEs of the components and the expression of the score."""
    items = DEFAULT_SCORES[name]
    short = name.split("_")[0]
    parts = [f"{short}{i} AS {pct_sql(c) if isinstance(c, Ranked) else mapped_sql(c)}" for i, (_, c) in enumerate(items)]
    total = " + ".join(f"{w}e0 * {short}{i}.v" for i, (w, _) in enumerate(items))
    joins = " ".join(f"JOIN {short}{i} USING (row_id)" for i in range(1, len(items)))
    parts.append(f"{name}_t AS (SELECT row_id, (0e0 + {total}) * 100 AS {name} FROM {short}0 {joins})")
    return ", ".join(parts), f"{name}_t"


def _scored(t: Tables, *names: str) -> DataFrame:
    return weighted_scores(t.entries, {n: DEFAULT_SCORES[n] for n in names}, digits=6, key="row_id")


def _score_sql(*names: str) -> str:
    ctes, tables = zip(*(score_ctes(n) for n in names))
    joined = " JOIN ".join([tables[0]] + [f"{x} USING (row_id)" for x in tables[1:]])
    return f"WITH {', '.join(ctes)} SELECT row_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM {joined}"


@query("pct_component", f"SELECT row_id, round(v, 10) AS part FROM {pct_sql(Ranked('energy_savings_kwh', True))}")
def _(t: Tables):
    scored = with_components(t.entries.select("row_id", "energy_savings_kwh"), {"part": Ranked("energy_savings_kwh", True)})
    return rounded(scored.select("row_id", "part"), 10)


@query("mapped_score", f"SELECT row_id, v AS part FROM {mapped_sql(Mapped('status', STATUS_SCORES))}")
def _(t: Tables):
    return with_components(t.entries.select("row_id", "status"), {"part": Mapped("status", STATUS_SCORES)}).select("row_id", "part")


@query("score_project_value", _score_sql("project_value_score"))
def _(t: Tables):
    return _scored(t, "project_value_score").select("row_id", "project_value_score")


@query("score_resource_eff", _score_sql("resource_efficiency_score"))
def _(t: Tables):
    return _scored(t, "resource_efficiency_score").select("row_id", "resource_efficiency_score")


@query("score_readiness", _score_sql("deployment_readiness_score"))
def _(t: Tables):
    return _scored(t, "deployment_readiness_score").select("row_id", "deployment_readiness_score")


@query("score_all", _score_sql(*DEFAULT_SCORES))
def _(t: Tables):
    return _scored(t, *DEFAULT_SCORES).select("row_id", *DEFAULT_SCORES)


# ---- trends and pivots ------------------------------------------------------


@query(
    "trend_share",
    """SELECT year, ai_technique, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 4) AS share
       FROM entries WHERE year IS NOT NULL AND ai_technique IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Tables):
    return reports.trend(t.entries)


@query(
    "trend_summary",
    """WITH pairs AS (SELECT year, ai_technique, count(*) AS n FROM entries GROUP BY 1, 2)
       SELECT count(*) AS total_rows, (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM pairs)) AS periods,
         count(DISTINCT ai_technique) AS unique_groups,
         (SELECT string_agg(ai_technique, ',' ORDER BY n DESC, ai_technique) FROM (SELECT ai_technique, sum(n) AS n FROM pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_groups
       FROM pairs""",
)
def _(t: Tables):
    out = reports.trend_summary(t.entries)
    return out.withColumns({"periods": F.array_join(F.col("periods").cast("array<string>"), ","), "top_groups": F.array_join("top_groups", ",")})


def _long_pivot(wide: DataFrame, key: str) -> DataFrame:
    return wide.unpivot([key], [c for c in wide.columns if c != key], "column", "count")


def _long_pivot_sql(key: str, col: str, k: int, where: str = "TRUE") -> str:
    return f"""WITH top AS (SELECT {col} AS c FROM entries WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k}),
      keys AS (SELECT DISTINCT {key} FROM entries WHERE {key} IS NOT NULL AND {where})
      SELECT {key}, c AS "column", (SELECT count(*) FROM entries e WHERE e.{key} = keys.{key} AND e.{col} = top.c) AS count FROM keys, top"""


@query("trend_pivot", _long_pivot_sql("year", "ai_technique", 5))
def _(t: Tables):
    return _long_pivot(pivots.top_pivot(t.entries, "year", "ai_technique", 5), "year")


@query("stress_pivot", _long_pivot_sql("water_stress_level", "ai_technique", 6))
def _(t: Tables):
    return _long_pivot(reports.stress_by_technique(t.entries), "water_stress_level")


@query(
    "entry_type_pivot",
    "SELECT year, "
    + ", ".join(f"count(*) FILTER (entry_type = '{k}') AS \"{k}\"" for k in reports.ENTRY_TYPES)
    + " FROM entries WHERE year IS NOT NULL GROUP BY 1",
)
def _(t: Tables):
    return reports.entry_types_by_year(t.entries)


@query("peak_year", "SELECT year, count(nexus_focus) AS total FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t: Tables):
    return pivots.peak_group(t.entries, "year", "nexus_focus")


@query(
    "crosstab",
    """SELECT * FROM (SELECT l_returnflag, l_linenumber, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 4) AS share
       FROM lineitem GROUP BY 1, 2) WHERE share > 0.01""",
)
def _(t: Tables):
    return pivots.crosstab(t.lineitem, "l_returnflag", "l_linenumber")


# ---- insight tables ---------------------------------------------------------


@query(
    "collab_perf",
    """SELECT collaboration_type, round(avg(coalesce(impact_score, (SELECT median(impact_score) FROM entries))), 2) AS avg_impact,
       round(avg(coalesce(investment_roi, (SELECT median(investment_roi) FROM entries))), 2) AS avg_roi, count(*) AS count
       FROM entries WHERE collaboration_type IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return reports.collaboration_performance(t.entries)


@query(
    "regional_policy",
    """SELECT region, round(avg(coalesce(policy_stringency_score, 0)), 2) AS avg_policy_stringency,
       round(avg(CASE WHEN lower(trim(coalesce(open_access, 'No'))) IN ('yes', 'green oa', 'gold oa') THEN 1e0 ELSE 0e0 END) * 100, 2) AS open_access_rate,
       count(*) AS count FROM entries GROUP BY 1""",
)
def _(t: Tables):
    return reports.regional_policy(t.entries)


@query(
    "resource_savings",
    """SELECT ai_technique, round(avg(coalesce(co2_reduction_tons, 0)), 2) AS avg_co2_reduction, round(avg(coalesce(water_savings_liters, 0)), 2) AS avg_water_savings,
       round(avg(coalesce(energy_savings_kwh, 0)), 2) AS avg_energy_savings, count(*) AS count FROM entries GROUP BY 1""",
)
def _(t: Tables):
    return reports.resource_savings(t.entries)


# ---- tags -------------------------------------------------------------------

TAGGED = "tagged AS (SELECT *, coalesce(regexp_extract_all(sdg_alignment, 'SDG\\s*\\d+'), []) AS tags FROM entries)"
EXPLODED = "exploded AS (SELECT *, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['Other'] END) AS tag FROM tagged)"


@query("tags_extract", f"WITH {TAGGED} SELECT row_id, array_to_string(tags, '|') AS tags FROM tagged")
def _(t: Tables):
    return tags.with_tags(t.entries.select("row_id", "sdg_alignment"), "sdg_alignment").select("row_id", F.array_join("tags", "|").alias("tags"))


@query("tags_distinct", f"WITH {TAGGED} SELECT DISTINCT unnest(tags) AS tag FROM tagged")
def _(t: Tables):
    return tags.distinct_tags(t.entries, "sdg_alignment")


@query("tags_primary", f"WITH {TAGGED} SELECT row_id, coalesce(tags[1], 'Other') AS tag FROM tagged")
def _(t: Tables):
    return t.entries.select("row_id", tags.primary_tag("sdg_alignment").alias("tag"))


MEMBERS = f"{TAGGED}, members AS (SELECT DISTINCT row_id, unnest(tags) AS tag FROM tagged)"
PAIRS = f"{MEMBERS}, pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS count FROM members a JOIN members b ON a.row_id = b.row_id AND a.tag < b.tag GROUP BY 1, 2)"


@query("tag_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def _(t: Tables):
    return tags.tag_pairs(t.entries, "sdg_alignment")


@query(
    "tag_jaccard",
    f"""WITH {PAIRS}, sizes AS (SELECT tag, count(*) AS n FROM members GROUP BY 1)
        SELECT tag_a || ' + ' || tag_b AS pair, tag_a, tag_b, count, round(count / (x.n + y.n - count), 4) AS jaccard
        FROM pairs JOIN sizes x ON x.tag = tag_a JOIN sizes y ON y.tag = tag_b""",
)
def _(t: Tables):
    return tags.tag_jaccard(t.entries, "sdg_alignment")


@query(
    "tag_intersect",
    """SELECT ai_technique AS technique, round(avg(CASE WHEN contains(coalesce(sdg_alignment, ''), 'SDG 6') THEN 1e0 ELSE 0e0 END), 4) AS sdg6_share,
       round(avg(CASE WHEN contains(coalesce(sdg_alignment, ''), 'SDG 7') THEN 1e0 ELSE 0e0 END), 4) AS sdg7_share FROM entries
       WHERE ai_technique IN (SELECT ai_technique FROM entries GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) GROUP BY 1""",
)
def _(t: Tables):
    return tags.tag_shares(t.entries, "ai_technique", "sdg_alignment")


_two = [score_ctes("project_value_score")[0], score_ctes("resource_efficiency_score")[0]]
SCORED = (
    f"{', '.join(_two)}, scored AS (SELECT entries.*, round(project_value_score, 6) AS project_value_score, round(resource_efficiency_score, 6) AS resource_efficiency_score "
    "FROM entries JOIN project_value_score_t USING (row_id) JOIN resource_efficiency_score_t USING (row_id)), "
)


@query(
    "tag_outcomes",
    f"""WITH {SCORED} {TAGGED.replace('FROM entries', 'FROM scored')}, {EXPLODED}
        SELECT tag, count(*) AS entries, coalesce(round(avg(project_value_score), 2), 0) AS avg_project_value_score,
          coalesce(round(avg(resource_efficiency_score), 2), 0) AS avg_resource_efficiency_score, coalesce(round(avg(funding_usd) / 1e6, 2), 0) AS avg_funding,
          coalesce(round(avg(co2_reduction_tons), 2), 0) AS avg_co2_reduction, coalesce(round(avg(impact_score), 2), 0) AS avg_impact FROM exploded GROUP BY 1""",
)
def _(t: Tables):
    return tags.tag_outcomes(_scored(t, "project_value_score", "resource_efficiency_score"), "sdg_alignment")


@query(
    "tag_synergy",
    f"""WITH {SCORED} {TAGGED.replace('FROM entries', 'FROM scored')}
        SELECT CASE WHEN len(tags) = 1 THEN 'Single Goal' ELSE 'Multi-Goal (Synergy)' END AS "group", round(avg(impact_score), 2) AS avg_impact,
          round(avg(resource_efficiency_score), 2) AS avg_resource_efficiency, count(*) AS count FROM tagged WHERE len(tags) > 0 GROUP BY 1""",
)
def _(t: Tables):
    return tags.tag_synergy(_scored(t, "project_value_score", "resource_efficiency_score"), "sdg_alignment")


@query(
    "tag_heatmap",
    f"""WITH {TAGGED}, {EXPLODED} SELECT * FROM (SELECT ai_technique, tag, count(*) AS count,
        round(count(*) / sum(count(*)) OVER (PARTITION BY ai_technique), 4) AS share FROM exploded WHERE ai_technique IS NOT NULL GROUP BY 1, 2) WHERE share > 0.01""",
)
def _(t: Tables):
    return tags.tag_heatmap(t.entries, "ai_technique", "sdg_alignment")


@query(
    "batch_reports",
    # one row per report table of the batch job over the cleaned, scored entries
)
def _(t: Tables):
    from tabulon.plans import batch

    done = batch.run_all(t.entries, "row_id")
    sections = {name: df for section in batch.RUN_TYPES for name, df in done[section].items()}
    sizes = [df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows")) for name, df in sections.items()]
    return reduce(DataFrame.unionAll, sizes)
