"""Exact invariants of the random and iterative operators, each with an SQL check.

The operators behind them draw or iterate, so that their rows cannot be said in
SQL; what must hold for any draw can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.operators import features as f
from tabulon.operators import models, runs, synth, text
from tabulon.operators import profiling as p
from tabulon.plans import batch
from tabulon.plans.queries.base import NUMERIC, Tables, query, rounded, union_all
from tabulon.plans.queries.models import FEATURES
from tabulon.plans.queries.text import TOKENS
from tabulon.session import scratch_dir
from tabulon.sources.catalog import extend
from tabulon.sources.results import ResultStore

LINEITEM_NUMBERS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
}


def _number_sql(c: str, kind: str, tail: str) -> str:
    return f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(*) FILTER ({c} IS NULL) AS nulls, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max, {tail} FROM lineitem"""


@query(
    "profile_columns_rows",
    union_all(
        [_number_sql(c, k, f'count(DISTINCT {c}) AS "distinct", round(avg({c}), 4) AS mean, NULL AS top') for c, k in LINEITEM_NUMBERS.items()]
        + [
            f"""SELECT '{c}', 'string', count(*) FILTER ({c} IS NULL), NULL, NULL, count(DISTINCT {c}), NULL,
                (SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)) FROM lineitem"""
            for c in ("l_returnflag", "l_linestatus")
        ]
    ),
)
def _(t: Tables):
    pairs = F.transform(F.map_entries("top_values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    rows = p.profile_columns(t.lineitem.drop("l_shipdate")).withColumn("top", F.when(F.col("top_values").isNotNull(), F.array_join(pairs, "|")))
    return rounded(rows.select("column", "dtype", "nulls", "min", "max", "distinct", "mean", "top"), 4, "mean")


@query("profile_approx_rows", union_all(_number_sql(c, k, "true AS near") for c, k in LINEITEM_NUMBERS.items()))
def _(t: Tables):
    exact = p.distinct_counts(t.lineitem, list(LINEITEM_NUMBERS)).withColumnRenamed("distinct", "exact")
    rows = p.profile_numeric(t.lineitem, approx=True).join(exact, "column")
    return rows.select("column", "dtype", "nulls", "min", "max", (F.abs(F.col("distinct") - F.col("exact")) <= 0.2 * F.col("exact")).alias("near"))


@query("split_parts", "SELECT count(*) AS rows, sum(o_orderkey) AS keys, CAST(0 AS BIGINT) AS in_both, true AS near FROM orders")
def _(t: Tables):
    train, test = f.split(t.orders, "o_orderkey")
    both = train.select("o_orderkey").join(test.select("o_orderkey"), "o_orderkey")
    parts = train.select("o_orderkey", F.lit(0).alias("t")).unionAll(test.select("o_orderkey", F.lit(1).alias("t")))
    sums = parts.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").cast("decimal(38,0)").alias("keys"), (F.abs(F.avg("t") - 0.2) < 0.05).alias("near"))
    return sums.join(both.agg(F.count(F.lit(1)).alias("in_both"))).select("rows", F.col("keys").cast("bigint").alias("keys"), "in_both", "near")


@query(
    "model_parts",
    """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS wrong_labels, CAST(0 AS BIGINT) AS wrong_residuals, CAST(5 AS BIGINT) AS folds, true AS importance_is_share,
       true AS metrics_agree, CAST((SELECT count(*) FROM orders) AS BIGINT) AS scored, CAST(0 AS BIGINT) AS unscored FROM entries""",
)
def _(t: Tables):
    prepared = models.prepare(t.entries, "impact_score", FEATURES, "row_id")
    linear = models.train_model(prepared, "Linear Regression")
    tree = models.train_model(prepared, "Decision Tree")
    left = linear.residuals().join(t.entries.select("row_id", "impact_score"), "row_id", "left")
    wrong = lambda test: F.count_if(~F.coalesce(test, F.lit(False)))
    rows = left.agg(
        F.count(F.lit(1)).alias("tested"),
        wrong(F.col("actual") == F.col("impact_score")).alias("wrong_labels"),
        wrong(F.abs(F.col("residual") - (F.col("actual") - F.col("predicted"))) < 1e-9).alias("wrong_residuals"),
        F.avg(F.col("residual") * F.col("residual")).alias("mse"),
    )
    folds = models.cv_r2(prepared, "Linear Regression", 5).agg(F.sum("n").alias("trained"), F.count(F.lit(1)).alias("folds"))
    share = tree.feature_importance().agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("importance_is_share"))
    said = linear.metrics().select(F.col("mse").alias("said"), F.col("rmse"))
    raw = t.entries.select("row_id", "year", F.lit("Nowhere").alias("region"), "sector", "investment_roi")
    scored = linear.score(raw).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("prediction").isNull()).alias("unscored"))
    one = rows.join(folds).join(share).join(said).join(scored)
    agree = (F.abs(F.col("mse") - F.col("said")) < 1e-9) & (F.abs(F.col("rmse") * F.col("rmse") - F.col("said")) < 1e-9)
    return one.select((F.col("tested") + F.col("trained")).alias("rows"), "wrong_labels", "wrong_residuals", "folds", "importance_is_share", agree.alias("metrics_agree"), "scored", "unscored")


@query(
    "generated_ranges",
    """SELECT count(*) AS rows, CAST(2 * count(*) AS BIGINT) AS extended, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unknown, true AS near FROM entries""",
)
def _(t: Tables):
    base = t.entries
    made = synth.generate(base, base.count(), 0.05, 7)
    extended = extend(base, made).agg(F.count(F.lit(1)).alias("extended"))
    lo, hi = ({c: F.min(c).alias(f"lo_{c}") for c in NUMERIC}, {c: F.max(c).alias(f"hi_{c}") for c in NUMERIC})
    limits = base.agg(*lo.values(), *hi.values(), F.avg("funding_usd").alias("mean"), F.stddev("funding_usd").alias("std"))
    beyond = sum((F.count_if(~F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))) for c in NUMERIC), F.lit(0))
    inside = made.join(limits).agg(
        F.count(F.lit(1)).alias("rows"), beyond.alias("outside"), (F.abs(F.avg("funding_usd") - F.first("mean")) < F.first("std")).alias("near")
    )
    strange = made.join(base.select(F.col("region").alias("known")).distinct(), F.col("region") == F.col("known"), "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return inside.join(strange).join(extended).select("rows", "extended", "outside", "unknown", "near")


@query(
    "text_parts",
    f"""SELECT count(*) AS docs, count(*) AS in_clusters, CAST(8 AS BIGINT) AS topics, true AS full_share, true AS few_clusters, CAST(count(*) AS BIGINT) AS profiled
        FROM documents WHERE len({TOKENS}) BETWEEN 5 AND 500""",
)
def _(t: Tables):
    features = text.tfidf(text.corpus(t.documents, "doc_id", ["text"], keep=["source"]))
    spread = text.topic_distribution(text.fit_topics(features), features).agg(
        F.sum("doc_count").alias("docs"), F.count(F.lit(1)).alias("topics"), (F.abs(F.sum("share") - 1) < 0.001).alias("full_share")
    )
    assigned = text.assign_clusters(text.fit_clusters(features), features)
    placed = assigned.agg(F.count(F.lit(1)).alias("in_clusters"), F.count_distinct("cluster").between(2, 6).alias("few_clusters"))
    profiled = text.cluster_profile(assigned, features, "source").agg(F.sum("size").alias("profiled"))
    return spread.join(placed).join(profiled).select("docs", "in_clusters", "topics", "full_share", "few_clusters", "profiled")


@query(
    "trained_models",
    "SELECT * FROM (VALUES ('Linear Regression'), ('Decision Tree'), ('Random Forest'), ('Gradient Boosting'), ('Ensemble (Voting)'), ('K-Means Clustering')) v(model_name)"
    " CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS rows, true AS metrics_agree FROM orders)",
)
def _(t: Tables):
    rows = models.train_all_models(t.entries, "impact_score", "row_id")
    agree = lambda m: m is not None and abs(m["rmse"] ** 2 - m["mse"]) < 1e-9 and m["r2"] <= 1 and m["mae"] <= m["rmse"] + 1e-9
    flat = [(r["model_name"], r.get("train_size", 0) + r.get("test_size", 0), agree(r.get("train_metrics")) and agree(r.get("test_metrics"))) for r in rows]
    return t.spark.createDataFrame(flat, "model_name string, rows bigint, metrics_agree boolean")


@query(
    "batch_runs",
    """SELECT * FROM (VALUES ('time_series', 2), ('nexus_insights', 5), ('nlp', 3), ('sdg_analysis', 6)) v(run_type, n)
       CROSS JOIN (SELECT CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years FROM orders)""",
)
def _(t: Tables):
    store = ResultStore(t.spark, scratch_dir(t.spark, "results"))
    done = batch.run_all(t.entries, "row_id")
    batch.store_all(store, done, scratch_dir(t.spark, "reports"))
    stored = runs.latest_runs(store.payload("tables map<string, struct<path: string, rows: bigint>>"))
    years = done["nexus_insights"]["entry_type_evolution"].count()
    return stored.select("run_type", F.size("tables").alias("n"), F.lit(years).cast("bigint").alias("years"))
