"""Registry of named queries over the supplied tables, with independent SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# One row per order, shaped like the wide table the operators are meant for: nulls,
# blanks, padded text, tags, messy numbers, outliers, structurally empty measures.
# Parts and documents are spread over the whole of their tables. Valid in both
# SQL dialects; a name in braces is a table.
ENTRIES = """
SELECT
  o_orderkey AS row_id,
  'E-' || CAST(o_orderkey AS STRING) AS entry_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Publication' WHEN 1 THEN 'Project' WHEN 2 THEN 'Patent' ELSE 'Policy' END AS entry_type,
  CAST(year(o_orderdate) AS INT) AS year,
  CAST(month(o_orderdate) AS INT) AS month,
  'Q' || CAST(quarter(o_orderdate) AS STRING) AS quarter,
  o_orderdate AS entry_ts,
  p_name AS title,
  d.text AS abstract_summary,
  n_name AS country,
  r_name AS region,
  CASE c_nationkey % 3 WHEN 0 THEN 'Arid' WHEN 1 THEN 'Temperate' ELSE 'Tropical' END AS climate_zone,
  CASE (o_custkey + o_orderkey) % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Low-Medium' WHEN 2 THEN 'Medium-High' WHEN 3 THEN 'High' ELSE 'Extremely High' END AS water_stress_level,
  'Org ' || CAST(o_custkey % 90 AS STRING) AS organization,
  CASE o_custkey % 6 WHEN 0 THEN 'Academic' WHEN 1 THEN 'Industry' WHEN 2 THEN ' Government ' WHEN 3 THEN 'Academic-Industry'
       WHEN 4 THEN 'Multi-Stakeholder Consortium' ELSE 'Informal' END AS collaboration_type,
  c_mktsegment AS sector,
  p_brand AS ai_technique,
  CASE WHEN o_orderkey % 19 = 0 THEN '  ' WHEN o_orderkey % 23 = 0 THEN NULL ELSE p_type END AS nexus_focus,
  CASE (o_orderkey * 7 + o_custkey) % 6 WHEN 0 THEN 'Local / Community' WHEN 1 THEN 'Pilot / Proof of Concept' WHEN 2 THEN 'City-Level'
       WHEN 3 THEN 'Regional' WHEN 4 THEN 'National' ELSE 'Global' END AS deployment_scale,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Ongoing' ELSE 'Proposed' END AS status,
  CASE (o_orderkey + o_custkey) % 7 WHEN 0 THEN 'SDG 6' WHEN 1 THEN 'SDG 7' WHEN 2 THEN 'SDG 6, SDG 7' WHEN 3 THEN 'SDG 6; SDG 13; SDG 13'
       WHEN 4 THEN 'SDG 7, SDG 9, SDG 13' WHEN 5 THEN 'None stated' END AS sdg_alignment,
  CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1000e0 ELSE o_totalprice * 10e0 END END AS funding_usd,
  CASE WHEN o_orderkey % 11 <> 0 THEN c_acctbal / 1000e0 END AS investment_roi,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey * 37 + o_orderkey) % 50000 END AS population_served,
  CAST(p_size AS DOUBLE) / 5e0 AS impact_score,
  CASE WHEN o_orderkey % 29 <> 0 THEN p_retailprice - 900e0 END AS innovation_index,
  CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice / 100e0 END AS co2_reduction_tons,
  CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice * 3e0 END AS water_savings_liters,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST((o_custkey * o_orderkey) % 9001 AS DOUBLE) - 50e0 END AS energy_savings_kwh,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS renewable_energy_share_pct,
  CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 400 END AS citation_count,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE o_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Green OA' WHEN 2 THEN ' gold oa ' ELSE 'No' END END AS open_access,
  CASE WHEN o_orderkey % 4 = 2 THEN o_custkey % 12 END AS patent_family_size,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Type ' || CAST(o_custkey % 5 AS STRING) END AS policy_type,
  CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_custkey % 10 AS DOUBLE) END AS policy_stringency_score,
  CASE WHEN o_orderkey % 8 = 0 THEN 'n/a' WHEN o_orderkey % 9 = 0 THEN ' 1,234 ' ELSE CAST(p_size AS STRING) END AS numeric_text,
  CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE '2024-01-1' || CAST(o_orderkey % 10 AS STRING) END AS date_text,
  CAST(NULL AS DOUBLE) AS all_null_num,
  7e0 AS constant_num
FROM (
  SELECT *, o_orderkey % (SELECT count(*) FROM {part}) AS part_ref, o_orderkey % (SELECT count(*) FROM {documents}) AS doc_ref
  FROM {orders}
) o
JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} ON n_nationkey = c_nationkey
JOIN {region} ON r_regionkey = n_regionkey
JOIN {part} ON p_partkey = part_ref
JOIN {documents} d ON d.doc_id = doc_ref
"""

# (name, Spark type) of the entries, in order.
ENTRY_COLUMNS = [
    tuple(item.split(":"))
    for item in (
        "row_id:bigint entry_id:string entry_type:string year:int month:int quarter:string entry_ts:timestamp_ntz "
        "title:string abstract_summary:string country:string region:string climate_zone:string "
        "water_stress_level:string organization:string collaboration_type:string sector:string ai_technique:string "
        "nexus_focus:string deployment_scale:string status:string sdg_alignment:string funding_usd:double "
        "investment_roi:double population_served:bigint impact_score:double innovation_index:double "
        "co2_reduction_tons:double water_savings_liters:double energy_savings_kwh:double "
        "renewable_energy_share_pct:double citation_count:bigint open_access:string patent_family_size:bigint "
        "policy_type:string policy_stringency_score:double numeric_text:string date_text:string "
        "all_null_num:double constant_num:double"
    ).split()
]
ENTRY_TYPES_BY_NAME = dict(ENTRY_COLUMNS)
# Tables that grow with the input: every pass over the entries would send those under the
# broadcast threshold through the driver once more, so they are joined by a shuffle.
GROWING = ("part", "documents", "customer")
NUMERIC = [c for c, kind in ENTRY_COLUMNS if kind in ("bigint", "int", "double")]
CATEGORICAL = [c for c, _ in ENTRY_COLUMNS if c not in NUMERIC]


class Tables:
    """The supplied tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entries(self) -> DataFrame:
        names = ("part", "documents", "orders", "customer", "nation", "region")
        views = {name: getattr(self, name) for name in names}
        return self.spark.sql(ENTRIES, **{name: df.hint("merge") if name in GROWING else df for name, df in views.items()})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the view ``entries`` and starts with
    SELECT or WITH."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_entries(sql)
        return build

    return register


def with_entries(sql: str) -> str:
    body = sql.strip()
    if "entries" not in body:
        return body
    view = f"entries AS MATERIALIZED ({ENTRIES.format(**{t: t for t in TABLES})})"
    if body.upper().startswith("WITH "):
        return f"WITH {view}, {body[5:]}"
    return f"WITH {view} {body}"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round double columns: engines add in different orders."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)
