"""Queries: grouped statistics behind plots."""

from __future__ import annotations

from tabulon.operators import ordered, plots
from tabulon.plans.queries.base import NUMERIC, Tables, query, rounded, union_all

CORRELATED = [c for c in NUMERIC if c != "all_null_num"]


def top_rows(group: str, x: str, k: int) -> str:
    """Complete rows (g, x) of the k largest groups."""
    return f"""rows AS (SELECT {group} AS g, CAST({x} AS DOUBLE) AS x FROM entries WHERE {group} IS NOT NULL AND {x} IS NOT NULL
        AND {group} IN (SELECT {group} FROM entries WHERE {group} IS NOT NULL AND {x} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k}))"""


def _histogram_sql(x: str, table: str, bins: int) -> str:
    return f"""WITH vals AS (SELECT CAST({x} AS DOUBLE) AS x FROM {table} WHERE {x} IS NOT NULL),
      range0 AS (SELECT min(x) AS a, max(x) AS b FROM vals),
      span AS (SELECT CASE WHEN a = b THEN a - 0.5e0 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5e0 ELSE b END AS hi FROM range0),
      bins AS (SELECT i AS bin, i * ((hi - lo) / {bins}e0) + lo AS l, CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}e0) + lo END AS r
               FROM range({bins}) t(i), span)
      SELECT bin, round(l, 6) AS "left", round(r, 6) AS "right",
             (SELECT count(*) FROM vals WHERE x >= l AND (x < r OR (bin = {bins - 1} AND x <= r))) AS count FROM bins"""


@query("histogram", _histogram_sql("funding_usd", "entries", 20))
def _(t: Tables):
    return rounded(plots.histogram(t.entries, "funding_usd"), 6)


@query("histogram_constant", _histogram_sql("constant_num", "entries", 5))
def _(t: Tables):
    return rounded(plots.histogram(t.entries, "constant_num", 5), 6)


@query("histogram_prices", _histogram_sql("l_extendedprice", "lineitem", 30))
def _(t: Tables):
    return rounded(plots.histogram(t.lineitem, "l_extendedprice", 30), 6)


def _box(group: str, x: str, k: int) -> str:
    return f"""WITH {top_rows(group, x, k)},
      q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, count(*) AS n FROM rows GROUP BY g),
      f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q WHERE n >= 2)"""


def _box_sql(group: str, x: str, k: int) -> str:
    return f"""{_box(group, x, k)}
      SELECT CAST(g AS VARCHAR) AS "group", round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3,
        round(coalesce(min(x) FILTER (x >= lower AND x <= upper), lower), 4) AS whisker_low,
        round(coalesce(max(x) FILTER (x >= lower AND x <= upper), upper), 4) AS whisker_high,
        count(*) FILTER (x < lower OR x > upper) AS n_outliers, count(*) AS count
      FROM rows JOIN f USING (g) GROUP BY g, q1, q2, q3, lower, upper"""


@query("boxplot", _box_sql("region", "funding_usd", 12))
def _(t: Tables):
    return rounded(plots.boxplot(t.entries, "funding_usd", "region"), 4)


@query("boxplot_many", _box_sql("organization", "energy_savings_kwh", 12))
def _(t: Tables):
    return rounded(plots.boxplot(t.entries, "energy_savings_kwh", "organization"), 4)


@query("boxplot_outliers", f"""{_box('region', 'funding_usd', 12)} SELECT g AS "group", x AS value FROM rows JOIN f USING (g) WHERE x < lower OR x > upper""")
def _(t: Tables):
    return plots.boxplot_outliers(t.entries, "funding_usd", "region")


def _bands(group: str, x: str, k: int) -> str:
    return f"""WITH {top_rows(group, x, k)},
      s AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, 0.9 * least(stddev_pop(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS rule
            FROM rows GROUP BY g),
      b AS (SELECT g, n, lo, hi, CASE WHEN rule = 0 THEN CASE WHEN hi > lo THEN 0.1 * (hi - lo) ELSE 1.0 END ELSE rule END AS bw,
            CASE WHEN hi > lo THEN (hi - lo) * 0.1 ELSE 1.0 END AS pad FROM s)"""


@query("kde_bandwidth", f"""{_bands('sector', 'funding_usd', 6)} SELECT g AS "group", n AS count, lo, hi, round(bw, 6) AS bandwidth FROM b""")
def _(t: Tables):
    return rounded(plots.kde_bandwidth(t.entries, "funding_usd", "sector"), 6, "bandwidth")


def _density_sql(group: str, x: str, k: int, grid: int) -> str:
    return f"""{_bands(group, x, k)},
      pts AS (SELECT g, n, bw, CAST(i AS INT) AS point, (lo - pad) + i * ((hi + pad - (lo - pad)) / {grid - 1}e0) AS pos FROM b, range({grid}) t(i) WHERE n >= 3),
      w AS (SELECT g, n, point, pos, sum(exp(-0.5 * ((pos - x) / bw) * ((pos - x) / bw))) AS w FROM pts JOIN rows USING (g) GROUP BY ALL)
      SELECT g AS "group", point, round(pos, 4) AS x, round(CASE WHEN sum(w) OVER (PARTITION BY g) > 0 THEN w / sum(w) OVER (PARTITION BY g) ELSE w END, 10) AS density,
        n AS count FROM w"""


@query("density", _density_sql("region", "funding_usd", 6, 100))
def _(t: Tables):
    return rounded(rounded(plots.density(t.entries, "funding_usd", "region"), 4, "x"), 10, "density")


@query("density_heavy_ties", _density_sql("region", "impact_score", 6, 100))
def _(t: Tables):
    return rounded(rounded(plots.density(t.entries, "impact_score", "region"), 4, "x"), 10, "density")


RADAR = ["impact_score", "innovation_index", "investment_roi", "renewable_energy_share_pct"]
_complete = " AND ".join(f"{m} IS NOT NULL" for m in ["sector", *RADAR])


@query(
    "radar",
    f"""SELECT sector AS "group", count(*) AS count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in RADAR)} FROM entries WHERE {_complete}
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4""",
)
def _(t: Tables):
    return rounded(plots.radar(t.entries, "sector", RADAR, 4), 6)


def _corr(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    spread = f"stddev_samp({a}) FILTER ({b} IS NOT NULL) * stddev_samp({b}) FILTER ({a} IS NOT NULL)"
    return f"round(covar_samp({a}, {b}) / nullif({spread}, 0), 3) + 0.0"


_pairs = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]
_upper = "row AS (SELECT " + ", ".join(f"{_corr(a, b)} AS r{i}" for i, (a, b) in enumerate(_pairs)) + " FROM entries)"
_long = union_all(f"SELECT '{a}' AS x, '{b}' AS y, r{i} AS value FROM row" for i, (a, b) in enumerate(_pairs))


@query("correlation", f"WITH {_upper} {_long}")
def _(t: Tables):
    return plots.correlation(t.entries)


_cells = [f"SELECT '{a}' AS x, '{b}' AS y, r{i} AS value FROM row" for i, (x, y) in enumerate(_pairs) for a, b in ((x, y), (y, x))]
_cells += [f"SELECT '{a}' AS x, '{a}' AS y, 1e0 AS value FROM row" for a in CORRELATED]


@query("correlation_matrix", f"WITH {_upper} {union_all(_cells)}")
def _(t: Tables):
    return plots.correlation_matrix(t.entries)


@query(
    "pct_rank",
    """SELECT row_id, investment_roi, CASE WHEN investment_roi IS NOT NULL THEN
       round((rank() OVER (ORDER BY investment_roi) + (count(*) OVER (PARTITION BY investment_roi) - 1) / 2e0) / count(investment_roi) OVER (), 10) END
       AS investment_roi_pct FROM entries""",
)
def _(t: Tables):
    ranked = ordered.pct_rank(t.entries.select("row_id", "investment_roi"), "investment_roi")
    return rounded(ranked, 10, "investment_roi_pct")


@query(
    "pct_rank_prices",
    """SELECT l_returnflag, count(*) AS n, round(avg(pct), 8) AS mean_pct, round(max(pct), 8) AS max_pct FROM (
       SELECT l_returnflag, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0) / count(l_extendedprice) OVER () AS pct
       FROM lineitem) GROUP BY 1""",
)
def _(t: Tables):
    from pyspark.sql import functions as F

    ranked = ordered.pct_rank(t.lineitem.select("l_returnflag", "l_extendedprice"), "l_extendedprice", "pct")
    means = [F.avg("pct").alias("mean_pct"), F.max("pct").alias("max_pct")]
    return rounded(ranked.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *means), 8)
