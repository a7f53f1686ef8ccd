"""Queries: sources, variants, filters, paging."""

from __future__ import annotations

from pyspark.sql import Observation, functions as F

from tabulon.functions.coerce import nonfinite_to_null
from tabulon.functions.labels import format_number
from tabulon.operators import filters
from tabulon.operators.cleaning import drop_na_rows
from tabulon.operators.plots import parallel_coords, scatter
from tabulon.operators.profiling import dataset_info
from tabulon.plans.queries.base import ENTRY_COLUMNS, Tables, query, rounded
from tabulon.session import scratch_dir
from tabulon.sources import tables
from tabulon.sources.catalog import Catalog, extend, extend_counts
from tabulon.sources.results import ResultStore
from tabulon.sources.snapshots import SnapshotStore

ALL_COLUMNS = [c for c, _ in ENTRY_COLUMNS]
NULL_SUM = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ALL_COLUMNS)


@query("csv_roundtrip", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t: Tables):
    path = scratch_dir(t.spark, "csv")
    source = t.events.select("event_id", "user_id", "event_type", "value")
    source.write.mode("overwrite").option("header", True).csv(path)
    back = tables.load_table(t.spark, [path + "-missing", path], schema=source.schema)
    return rounded(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("trim_headers", "SELECT row_id, region, sector FROM entries")
def _(t: Tables):
    padded = t.entries.select(F.col("row_id").alias(" row_id"), F.col("region").alias("region  "), F.col("sector").alias("\tsector "))
    return tables.trim_headers(padded)


@query("trim_strings", "SELECT row_id, trim(collaboration_type) AS collaboration_type, trim(nexus_focus) AS nexus_focus, trim(open_access) AS open_access FROM entries")
def _(t: Tables):
    return tables.trim_strings(t.entries.select("row_id", "collaboration_type", "nexus_focus", "open_access"))


@query(
    "nonfinite_to_null",
    """SELECT l_linenumber, count(*) AS n, count(x) AS finite, round(sum(x), 2) AS total FROM (
         SELECT l_linenumber, CASE WHEN l_partkey % 5 < 3 THEN NULL ELSE l_extendedprice END AS x FROM lineitem)
       GROUP BY l_linenumber""",
)
def _(t: Tables):
    bad = F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (F.col("l_partkey") % 5 + 1).cast("int"))
    x = F.when(F.col("l_partkey") % 5 < 3, bad.cast("double")).otherwise(F.col("l_extendedprice"))
    clean = nonfinite_to_null(t.lineitem.select("l_linenumber", x.alias("x")))
    return clean.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("finite"), F.round(F.sum("x"), 2).alias("total"))


@query(
    "variants",
    """SELECT v AS variant, CASE WHEN v = 'cleaned' THEN count(funding_usd) ELSE count(*) END AS rows
       FROM entries, (VALUES ('original'), ('cleaned'), ('extended')) t(v) GROUP BY v""",
)
def _(t: Tables):
    catalog = Catalog(t.entries.select("row_id", "funding_usd"))
    catalog.put("cleaned", drop_na_rows(catalog.get(), "funding_usd"))
    size = lambda name: catalog.get(name).agg(F.lit(name).alias("variant"), F.count(F.lit(1)).alias("rows"))
    return size("original").union(size("cleaned")).union(size("extended"))


@query(
    "dataset_status",
    f"""SELECT count(*) AS rows, {len(ALL_COLUMNS)} AS columns, '{",".join(ALL_COLUMNS)}' AS column_names,
        '{";".join(f"{c}={k}" for c, k in sorted(ENTRY_COLUMNS))}' AS dtypes,
        round(({NULL_SUM}) * 100.0 / (count(*) * {len(ALL_COLUMNS)}), 2) AS null_pct FROM entries""",
)
def _(t: Tables):
    pairs = F.array_sort(F.map_entries("dtypes"))
    return dataset_info(t.entries).withColumns(
        {
            "column_names": F.array_join("column_names", ","),
            "dtypes": F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"])), ";"),
        }
    )


def _new_rows(t: Tables):
    return t.events.select((F.col("event_id") + 1_000_000_000).alias("row_id"), F.col("event_type").alias("region"), F.col("value").alias("event_value"))


@query(
    "extend_union",
    """SELECT row_id, region, funding_usd, CAST(NULL AS DOUBLE) AS event_value FROM entries
       UNION ALL SELECT event_id + 1000000000, event_type, NULL, value FROM events""",
)
def _(t: Tables):
    return extend(t.entries.select("row_id", "region", "funding_usd"), _new_rows(t))


@query(
    "extend_counts",
    "SELECT CAST((SELECT count(*) FROM orders) + count(*) AS BIGINT) AS total_rows, count(*) AS added_rows FROM events",
)
def _(t: Tables):
    return extend_counts(t.orders, _new_rows(t))


_MISSING = ", ".join(f"'{m}'" for m in tables.MISSING)


@query(
    "csv_types_and_rejects",
    f"""WITH c AS (SELECT nullif(trim(numeric_text), 'n/a') AS x, date_text AS d, CASE WHEN trim(nexus_focus) IN ({_MISSING}) THEN NULL ELSE nexus_focus END AS f FROM entries)
    SELECT 'schema' AS way, 'row_id' AS "column", 'bigint' AS dtype, count(*) AS cells, CAST(0 AS BIGINT) AS rejects FROM c
    UNION ALL SELECT 'schema', 'numeric_text', 'int', count(x), count(x) FILTER (TRY_CAST(x AS INT) IS NULL) FROM c
    UNION ALL SELECT 'schema', 'date_text', 'date', count(d), count(d) FILTER (TRY_CAST(d AS DATE) IS NULL) FROM c
    UNION ALL SELECT 'schema', 'nexus_focus', 'string', count(f), 0 FROM c
    UNION ALL SELECT 'inferred', 'row_id', 'bigint', count(*), 0 FROM c
    UNION ALL SELECT 'inferred', 'numeric_text', 'string', count(x), 0 FROM c
    UNION ALL SELECT 'inferred', 'date_text', 'string', count(d), 0 FROM c
    UNION ALL SELECT 'inferred', 'nexus_focus', 'string', count(f), 0 FROM c""",
)
def _(t: Tables):
    path = scratch_dir(t.spark, "csv")
    t.entries.select("row_id", "numeric_text", "date_text", "nexus_focus").write.mode("overwrite").option("header", True).csv(path)
    out = None
    for way, schema in (("schema", "row_id bigint, numeric_text int, date_text date, nexus_focus string"), ("inferred", None)):
        rejects = Observation(way)
        df = tables.load_table(t.spark, path, schema=schema, rejects=rejects)
        df.write.format("noop").mode("overwrite").save()
        rows = tables.reject_counts(df, rejects).select(F.lit(way).alias("way"), "column", "dtype", "cells", "rejects")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snapshot_roundtrip", "SELECT row_id, region, funding_usd FROM entries WHERE funding_usd IS NOT NULL")
def _(t: Tables):
    store = SnapshotStore(t.spark, scratch_dir(t.spark, "snapshots"))
    taken = store.take(drop_na_rows(t.entries.select("row_id", "region", "funding_usd"), "funding_usd"), "cleaned", "no gaps")
    return store.restore(taken)[1]


@query(
    "snapshot_list",
    """SELECT 'cleaned' AS variant, 'no gaps' AS label, count(*) FILTER (funding_usd IS NOT NULL) AS rows, 2 AS cols FROM entries
       UNION ALL SELECT 'extended', 'extended snapshot', (SELECT count(*) FROM entries) + count(*), 4 FROM events""",
)
def _(t: Tables):
    store = SnapshotStore(t.spark, scratch_dir(t.spark, "snapshots"))
    base = t.entries.select("row_id", "region", "funding_usd")
    store.take(drop_na_rows(base.select("row_id", "funding_usd"), "funding_usd"), "cleaned", "no gaps")
    store.take(extend(base, _new_rows(t)), "extended")
    return store.list().select("variant", "label", "rows", "cols")


@query(
    "results_roundtrip",
    """SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) AS BIGINT) AS place, o_orderpriority AS target_col, count(*) AS train_size,
       round(avg(o_totalprice), 2) AS mean, '{"note": "x"}' AS payload FROM orders GROUP BY 2
       QUALIFY row_number() OVER (ORDER BY o_orderpriority) > 1""",
)
def _(t: Tables):
    store = ResultStore(t.spark, scratch_dir(t.spark, "results"))
    rows = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).orderBy("o_orderpriority").collect()
    ids = store.append_all(
        [{"run_type": "ml_model", "model_name": "mean", "target_col": r[0], "train_size": r[1], "test_metrics": {"mean": r[2]}, "note": "x"} for r in rows]
    )
    store.delete(ids[0])
    place = (F.element_at(F.split("id", "-"), 3).cast("bigint") + 1).alias("place")
    return store.read().select(place, "target_col", "train_size", F.round(F.try_element_at("test_metrics", F.lit("mean")), 2).alias("mean"), "payload")


@query(
    "results_payload",
    "SELECT o_orderpriority AS target_col, CAST(count(*) AS BIGINT) AS orders, max(o_orderstatus) AS top FROM orders GROUP BY 1",
)
def _(t: Tables):
    store = ResultStore(t.spark, scratch_dir(t.spark, "results"))
    rows = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("top")).collect()
    store.append_all([{"run_type": "counts", "target_col": r[0], "orders": r["n"], "top": r["top"]} for r in rows])
    return store.payload("orders bigint, top string").select("target_col", "orders", "top")


# ---- filters ----------------------------------------------------------------


@query("filter_eq", "SELECT row_id, collaboration_type FROM entries WHERE trim(collaboration_type) = 'Government'")
def _(t: Tables):
    return filters.filter_by(t.entries, "collaboration_type", "==", " Government ").select("row_id", "collaboration_type")


@query("filter_eq_number", "SELECT row_id, population_served FROM entries WHERE population_served = 37 OR population_served = 1234")
def _(t: Tables):
    df = t.entries.select("row_id", "population_served")
    return filters.filter_by(df, "population_served", "==", "37").unionAll(filters.filter_by(df, "population_served", "==", " 1234 "))


@query("filter_ne", "SELECT row_id, nexus_focus FROM entries WHERE nexus_focus IS NULL OR trim(nexus_focus) <> 'PROMO'")
def _(t: Tables):
    return filters.filter_by(t.entries, "nexus_focus", "!=", "PROMO").select("row_id", "nexus_focus")


NUMBER_TEXT = "CASE WHEN regexp_matches(trim(numeric_text), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(numeric_text) AS DOUBLE) END"


@query("filter_gt", f"SELECT row_id, numeric_text FROM entries WHERE {NUMBER_TEXT} > 30")
def _(t: Tables):
    return filters.filter_by(t.entries, "numeric_text", ">", "30").select("row_id", "numeric_text")


@query("filter_lt", "SELECT row_id, funding_usd FROM entries WHERE funding_usd < 1000000")
def _(t: Tables):
    return filters.filter_by(t.entries, "funding_usd", "<", "1e6").select("row_id", "funding_usd")


@query("filter_ge", "SELECT row_id, year FROM entries WHERE year >= 1996")
def _(t: Tables):
    return filters.filter_by(t.entries, "year", ">=", "1996").select("row_id", "year")


@query("filter_le", f"SELECT row_id, numeric_text FROM entries WHERE {NUMBER_TEXT} <= 5")
def _(t: Tables):
    return filters.filter_by(t.entries, "numeric_text", "<=", "5").select("row_id", "numeric_text")


@query("filter_contains", "SELECT row_id, country FROM entries WHERE regexp_matches(country, '(?i)^nation_1$|N.2')")
def _(t: Tables):
    return filters.filter_by(t.entries, "country", "contains", "^nation_1$|N.2").select("row_id", "country")


@query("filter_counts", "SELECT count(*) AS total_before, count(*) FILTER (funding_usd >= 2500000.5) AS total_after FROM entries")
def _(t: Tables):
    return filters.filter_counts(t.entries, "funding_usd", ">=", "2500000.5")


@query("filter_page", "SELECT row_id, region FROM entries WHERE region = 'ASIA' ORDER BY row_id LIMIT 100")
def _(t: Tables):
    return filters.filter_page(t.entries.select("row_id", "region"), "region", "==", "ASIA", "row_id")


@query("filter_rows_expr", "SELECT row_id, region, impact_score FROM entries WHERE impact_score > 5 AND region IN ('ASIA', 'EUROPE')")
def _(t: Tables):
    return filters.filter_rows(t.entries, "impact_score > 5 AND region IN ('ASIA', 'EUROPE')").select("row_id", "region", "impact_score")


@query("rows_page", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 50 OFFSET 200")
def _(t: Tables):
    return filters.rows_page(t.events.select("event_id", "user_id", "event_type", "value"), "event_id", 200, 50)


@query("rows_after", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id > 299 ORDER BY event_id LIMIT 50")
def _(t: Tables):
    return filters.rows_after(t.events.select("event_id", "user_id", "event_type", "value"), "event_id", 299, 50)


@query(
    "search_any",
    """SELECT p_partkey, p_name, p_brand FROM part
       WHERE contains(lower(concat_ws(chr(1), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'd w')
          OR contains(lower(concat_ws(chr(1), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), '99')""",
)
def _(t: Tables):
    hits = filters.search(t.part, "D W").union(filters.search(t.part, "99"))
    return hits.distinct().select("p_partkey", "p_name", "p_brand")


@query("project_columns", "SELECT row_id, region, sector, funding_usd FROM entries")
def _(t: Tables):
    return filters.project(t.entries, ["row_id", "region", "sector", "funding_usd"])


@query(
    "scatter",
    """SELECT funding_usd AS x, investment_roi AS y, region AS color FROM entries
       WHERE funding_usd IS NOT NULL AND investment_roi IS NOT NULL ORDER BY row_id LIMIT 2000""",
)
def _(t: Tables):
    return scatter(t.entries, "funding_usd", "investment_roi", "row_id", "region")


@query(
    "parallel_coords",
    """SELECT impact_score, innovation_index, CAST(population_served AS DOUBLE) AS population_served, sector AS color FROM entries
       WHERE impact_score IS NOT NULL AND innovation_index IS NOT NULL AND population_served IS NOT NULL ORDER BY row_id LIMIT 500""",
)
def _(t: Tables):
    return parallel_coords(t.entries, ["impact_score", "innovation_index", "population_served"], "row_id", "sector")


@query(
    "format_number",
    """SELECT o_orderkey, CASE WHEN x IS NULL THEN '-' WHEN abs(x) >= 1e9 THEN printf('%.1fB', x / 1e9)
         WHEN abs(x) >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN abs(x) >= 1e3 THEN printf('%.1fK', x / 1e3)
         WHEN x = floor(x) THEN printf('%.0f', x) ELSE printf('%.4f', x) END AS label
       FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice * 10000e0 WHEN 1 THEN o_totalprice * 10e0
         WHEN 2 THEN o_totalprice / 1000e0 WHEN 3 THEN CAST(o_custkey % 1000 AS DOUBLE) END AS x FROM orders)""",
)
def _(t: Tables):
    kind = F.col("o_orderkey") % 5
    x = (
        F.when(kind == 0, F.col("o_totalprice") * 1e4)
        .when(kind == 1, F.col("o_totalprice") * 10.0)
        .when(kind == 2, F.col("o_totalprice") / 1e3)
        .when(kind == 3, (F.col("o_custkey") % 1000).cast("double"))
    )
    return t.orders.select("o_orderkey", format_number(x).alias("label"))
