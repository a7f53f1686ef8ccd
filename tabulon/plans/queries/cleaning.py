"""Queries: cleaning steps and composed cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import cleaning as c
from tabulon.operators import ordered
from tabulon.plans.queries.access import NUMBER_TEXT
from tabulon.plans.queries.base import CATEGORICAL, ENTRY_TYPES_BY_NAME, NUMERIC, Tables, query, rounded
from tabulon.sources.spec import DEFAULT_SPEC


def quartiles(x: str, source: str) -> str:
    return f"(SELECT quantile_cont(CAST({x} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({x} AS DOUBLE), 0.75) AS q3 FROM {source})"


def fence(x: str, factor: float) -> str:
    return f"{x} BETWEEN q1 - {factor} * (q3 - q1) AND q3 + {factor} * (q3 - q1)"


def mode_of(x: str, source: str = "entries") -> str:
    return f"(SELECT v FROM (SELECT {x} AS v, count(*) AS n FROM {source} WHERE {x} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"


def nonblank(x: str) -> str:
    return f"CASE WHEN trim({x}) <> '' THEN {x} END"


@query("clean_drop_na_rows", "SELECT row_id, funding_usd, investment_roi FROM entries WHERE funding_usd IS NOT NULL")
def _(t: Tables):
    return c.drop_na_rows(t.entries.select("row_id", "funding_usd", "investment_roi"), "funding_usd")


@query("clean_drop_na_rows_any", "SELECT row_id, funding_usd, investment_roi FROM entries WHERE funding_usd IS NOT NULL AND investment_roi IS NOT NULL")
def _(t: Tables):
    return c.drop_na_rows(t.entries.select("row_id", "funding_usd", "investment_roi"))


@query("clean_drop_na_cols", "SELECT row_id, constant_num, funding_usd FROM entries")
def _(t: Tables):
    return c.drop_na_cols(t.entries.select("row_id", "constant_num", "all_null_num", "funding_usd"))


@query("clean_fill_mean", "SELECT row_id, round(coalesce(investment_roi, (SELECT avg(investment_roi) FROM entries)), 6) AS investment_roi FROM entries")
def _(t: Tables):
    return rounded(c.fill_mean(t.entries.select("row_id", "investment_roi"), "investment_roi"), 6)


def _median(x: str) -> str:
    return f"coalesce({x}, (SELECT quantile_cont(CAST({x} AS DOUBLE), 0.5) FROM entries)) AS {x}"


@query(
    "clean_fill_median",
    f"SELECT row_id, {_median('funding_usd')}, CAST({_median('population_served')[:-len(' AS population_served')]} AS DOUBLE) AS population_served, {_median('innovation_index')}, all_null_num FROM entries",
)
def _(t: Tables):
    columns = ["funding_usd", "population_served", "innovation_index", "all_null_num"]
    filled = c.fill_median(t.entries.select("row_id", *columns), columns)
    return filled.withColumn("population_served", F.col("population_served").cast("double"))


@query("clean_fill_mode", f"SELECT row_id, coalesce(nexus_focus, {mode_of('nexus_focus')}) AS nexus_focus, coalesce(citation_count, {mode_of('citation_count')}) AS citation_count FROM entries")
def _(t: Tables):
    filled = c.fill_mode(t.entries.select("row_id", "nexus_focus", "citation_count"), "nexus_focus")
    return c.fill_mode(filled, "citation_count")


@query(
    "clean_fill_mode_config",
    f"""SELECT row_id, coalesce({nonblank('nexus_focus')}, {mode_of(nonblank('nexus_focus'))}) AS nexus_focus,
        coalesce({nonblank('policy_type')}, 'not_policy') AS policy_type, coalesce({nonblank('open_access')}, 'unknown') AS open_access,
        coalesce({nonblank('sdg_alignment')}, {mode_of(nonblank('sdg_alignment'))}) AS sdg_alignment FROM entries""",
)
def _(t: Tables):
    columns = ["nexus_focus", "policy_type", "open_access", "sdg_alignment"]
    return c.fill_mode_or_placeholder(t.entries.select("row_id", *columns), columns)


@query(
    "clean_placeholder",
    f"""SELECT row_id, coalesce({nonblank('policy_type')}, 'not_policy') AS policy_type, coalesce({nonblank('open_access')}, 'unknown') AS open_access,
        coalesce({nonblank('nexus_focus')}, 'unknown') AS nexus_focus,
        coalesce(CASE WHEN region <> 'ASIA' THEN region END, 'unknown_region') AS region,
        coalesce(CASE WHEN row_id % 3 = 0 THEN organization END, 'unknown_organization') AS lead_org FROM entries""",
)
def _(t: Tables):
    df = t.entries.select(
        "row_id", "policy_type", "open_access", "nexus_focus",
        F.when(F.col("region") != "ASIA", F.col("region")).alias("region"),
        F.when(F.col("row_id") % 3 == 0, F.col("organization")).alias("lead_org"),
    )
    return c.fill_placeholder(df, df.columns[1:])


@query("clean_fill_constant", "SELECT row_id, coalesce(funding_usd, 0) AS funding_usd, coalesce(nexus_focus, 'none') AS nexus_focus FROM entries")
def _(t: Tables):
    return c.fill_constant(c.fill_constant(t.entries.select("row_id", "funding_usd", "nexus_focus"), "funding_usd", 0), "nexus_focus", "none")


PAST = "OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FUTURE = "OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("clean_ffill", f"SELECT row_id, last_value(investment_roi IGNORE NULLS) {PAST} AS investment_roi, last_value(sdg_alignment IGNORE NULLS) {PAST} AS sdg_alignment FROM entries")
def _(t: Tables):
    columns = ["investment_roi", "sdg_alignment"]
    return ordered.fill_forward(t.entries.select("row_id", *columns), columns, "row_id")


@query("clean_bfill", f"SELECT row_id, first_value(investment_roi IGNORE NULLS) {FUTURE} AS investment_roi, first_value(policy_type IGNORE NULLS) {FUTURE} AS policy_type FROM entries")
def _(t: Tables):
    columns = ["investment_roi", "policy_type"]
    return ordered.fill_backward(t.entries.select("row_id", *columns), columns, "row_id")


@query(
    "clean_interpolate",
    f"""WITH placed AS (SELECT row_id, investment_roi AS x, row_number() OVER (ORDER BY row_id) AS p FROM entries),
        near AS (SELECT *, last_value(x IGNORE NULLS) {PAST} AS pv, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) {PAST} AS pp,
                 first_value(x IGNORE NULLS) {FUTURE} AS nv, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) {FUTURE} AS np FROM placed)
        SELECT row_id, round(CASE WHEN x IS NOT NULL THEN x WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN pv
               ELSE pv + (nv - pv) * (p - pp) / (np - pp) END, 6) + 0.0 AS investment_roi
        FROM near""",
)
def _(t: Tables):
    return rounded(ordered.interpolate(t.entries.select("row_id", "investment_roi"), "investment_roi", "row_id"), 6)


@query(
    "clean_zscore",
    """SELECT row_id, funding_usd FROM entries, (SELECT avg(funding_usd) AS m, stddev_samp(funding_usd) AS s FROM entries)
       WHERE abs((funding_usd - m) / s) < 3""",
)
def _(t: Tables):
    return c.remove_outliers_zscore(t.entries.select("row_id", "funding_usd"), "funding_usd")


@query("clean_iqr_drop_nulls", f"SELECT row_id, funding_usd FROM entries, {quartiles('funding_usd', 'entries')} WHERE {fence('funding_usd', 1.5)}")
def _(t: Tables):
    return c.remove_outliers_iqr(t.entries.select("row_id", "funding_usd"), "funding_usd")


SPEC_OUTLIERS = DEFAULT_SPEC["cleaning"][-1]["columns"]


def sequential(columns, factor: float, source: str, keep_nulls: bool) -> tuple[str, str]:
    """CTEs that filter one column after another, and the name of the last one."""
    parts, last = [], source
    for i, x in enumerate(columns):
        name = f"step{i}"
        rule = fence(x, factor)
        if keep_nulls:
            rule = f"(q3 IS NULL OR NOT q3 - q1 > 0 OR {x} IS NULL OR {rule})"
        else:
            rule = f"(q3 IS NULL OR {rule})"
        parts.append(f"{name} AS (SELECT {last}.* FROM {last}, {quartiles(x, last)} WHERE {rule})")
        last = name
    return ", ".join(parts), last


_steps, _last = sequential(SPEC_OUTLIERS, 3.0, "entries", True)


@query("clean_iqr_config", f"WITH {_steps} SELECT row_id, {', '.join(SPEC_OUTLIERS)} FROM {_last}")
def _(t: Tables):
    return c.remove_outliers_iqr_keep_nulls(t.entries.select("row_id", *SPEC_OUTLIERS), SPEC_OUTLIERS, 3.0)


@query("clean_dedupe_key", "SELECT row_id, organization, region FROM entries QUALIFY row_number() OVER (PARTITION BY organization ORDER BY row_id) = 1")
def _(t: Tables):
    return c.remove_duplicates(t.entries.select("row_id", "organization", "region"), "organization", "row_id")


@query("clean_dedupe_all", "SELECT DISTINCT l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def _(t: Tables):
    return c.remove_duplicates(t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"))


@query("clean_strip", "SELECT row_id, trim(collaboration_type) AS collaboration_type FROM entries")
def _(t: Tables):
    return c.strip_whitespace(t.entries.select("row_id", "collaboration_type"), "collaboration_type")


@query("clean_lower", "SELECT row_id, lower(nexus_focus) AS nexus_focus FROM entries")
def _(t: Tables):
    return c.lowercase(t.entries.select("row_id", "nexus_focus"), "nexus_focus")


@query("clean_to_numeric", f"SELECT row_id, {NUMBER_TEXT} AS numeric_text FROM entries")
def _(t: Tables):
    return c.to_numeric(t.entries.select("row_id", "numeric_text"), "numeric_text")


@query("clean_to_datetime", "SELECT row_id, strftime(TRY_CAST(date_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS date_text FROM entries")
def _(t: Tables):
    parsed = c.to_datetime(t.entries.select("row_id", "date_text"), "date_text")
    return parsed.withColumn("date_text", F.date_format("date_text", "yyyy-MM-dd HH:mm:ss"))


@query("clean_drop_columns", "SELECT row_id, region FROM entries")
def _(t: Tables):
    return c.drop_columns(t.entries.select("row_id", "region", "sector", "status"), ["sector", "status", "not_there"])


@query("clean_rename", "SELECT row_id, region AS area FROM entries")
def _(t: Tables):
    return c.rename_column(t.entries.select("row_id", "region"), "region", "area")


def _auto_cell(x: str) -> str:
    """A cell after the fills of the automatic cleaning."""
    if x in NUMERIC:
        return f"coalesce(CAST({x} AS DOUBLE), (SELECT quantile_cont(CAST({x} AS DOUBLE), 0.5) FROM entries)) AS {x}"
    if ENTRY_TYPES_BY_NAME[x] != "string":
        return x
    fill = f"'{c.placeholder(x)}'" if x in c.ALWAYS_PLACEHOLDER else f"coalesce({mode_of(nonblank(x))}, '{c.placeholder(x)}')"
    return f"coalesce({nonblank(x)}, {fill}) AS {x}"


AUTO = [x for x in ENTRY_TYPES_BY_NAME if x not in c.TEXT_COLUMNS]
_steps, _last = sequential([x for x in AUTO if x in NUMERIC], 1.5, "filled", False)
_out = ", ".join(f"strftime({x}, '%Y-%m-%d') AS {x}" if x == "entry_ts" else x for x in AUTO)


@query("auto_clean", f"WITH filled AS (SELECT {', '.join(map(_auto_cell, AUTO))} FROM entries), {_steps} SELECT {_out} FROM {_last}")
def _(t: Tables):
    clean = c.auto_clean(t.entries)
    return clean.withColumns({"entry_ts": F.date_format("entry_ts", "yyyy-MM-dd")} | {x: F.col(x).cast("double") for x in AUTO if x in NUMERIC})


STEPS = [
    {"operation": "fill_na_ffill", "column": "co2_reduction_tons"},
    {"operation": "strip_whitespace", "column": "collaboration_type"},
    {"operation": "to_numeric", "column": "numeric_text"},
    {"operation": "to_datetime", "column": "date_text"},
    {"operation": "fill_na_mean", "column": "investment_roi"},
    {"operation": "fill_na_median", "column": "innovation_index"},
    {"operation": "fill_na_constant", "column": "policy_type", "value": "none"},
    {"operation": "drop_na_rows", "column": "funding_usd"},
    {"operation": "drop_na_cols"},
    {"operation": "remove_outliers_iqr", "column": "funding_usd", "value": 3},
    {"operation": "lowercase", "column": "not_there"},
    {"operation": "remove_duplicates", "column": "organization"},
    {"operation": "rename_column", "column": "sector", "value": "market"},
    {"operation": "drop_column", "column": "title"},
    {"operation": "filter_rows", "value": "year >= 1994"},
]
_nulls = {x: f"{x} IS NULL" for x in ENTRY_TYPES_BY_NAME}
_before = " + ".join(f"count(*) FILTER ({test})" for test in _nulls.values())
_changed = _nulls | {
    "numeric_text": "number IS NULL",
    "date_text": "TRY_CAST(date_text AS TIMESTAMP) IS NULL",
    "co2_reduction_tons": "row_id < (SELECT min(row_id) FROM entries WHERE co2_reduction_tons IS NOT NULL)",
}
_gone = ("all_null_num", "title")
_after = " + ".join(f"count(*) FILTER ({test})" for x, test in _changed.items() if x not in (*_gone, "investment_roi", "innovation_index", "policy_type"))


@query(
    "clean_report",
    f"""WITH present AS (SELECT *, {NUMBER_TEXT} AS number FROM entries WHERE funding_usd IS NOT NULL),
        inside AS (SELECT present.* FROM present, {quartiles('funding_usd', 'present')} WHERE {fence('funding_usd', 3.0)}),
        clean AS (SELECT * FROM (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY organization ORDER BY row_id) = 1) WHERE year >= 1994)
        SELECT a.*, b.* FROM (SELECT count(*) AS rows_before, {len(_nulls)} AS cols_before, CAST({_before} AS BIGINT) AS nulls_before FROM entries) a,
        (SELECT count(*) AS rows_after, {len(_nulls) - len(_gone)} AS cols_after, CAST({_after} AS BIGINT) AS nulls_after FROM clean) b""",
)
def _(t: Tables):
    return c.cleaning_report(t.entries, c.apply_steps(c.presence_only(t.entries, STEPS, "row_id"), STEPS, "row_id"))


def _config_cell(x: str) -> str:
    kind = ENTRY_TYPES_BY_NAME[x]
    if x in DEFAULT_SPEC["cleaning"][1]["columns"]:
        return f"coalesce({x}, (SELECT quantile_cont(CAST({x} AS DOUBLE), 0.5) FROM entries)) AS {x}"
    if x in CATEGORICAL and kind == "string":
        fill = f"'{c.placeholder(x)}'" if x in c.ALWAYS_PLACEHOLDER else f"coalesce({mode_of(nonblank(x))}, '{c.placeholder(x)}')"
        return f"coalesce({nonblank(x)}, {fill}) AS {x}"
    return x


_dropped = DEFAULT_SPEC["cleaning"][0]["columns"]
_kept = [x for x in ENTRY_TYPES_BY_NAME if x not in _dropped]
_steps, _last = sequential(SPEC_OUTLIERS, 3.0, "filled", True)
_out = ", ".join(
    "strftime(entry_ts, '%Y-%m-%d') AS entry_ts" if x == "entry_ts" else f"CAST({x} AS DOUBLE) AS {x}" if x == "population_served" else "CAST(year AS INT) AS year" if x == "year" else x
    for x in _kept
)


@query("clean_config", f"WITH filled AS (SELECT {', '.join(_config_cell(x) for x in _kept)} FROM entries), {_steps} SELECT {_out} FROM {_last}")
def _(t: Tables):
    clean = c.apply_config(t.entries, DEFAULT_SPEC)
    return clean.withColumns({"entry_ts": F.date_format("entry_ts", "yyyy-MM-dd"), "population_served": F.col("population_served").cast("double")})
