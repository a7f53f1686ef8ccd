"""Queries: synthetic rows, feature preparation, regression, run results."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tabulon.operators import features as f
from tabulon.operators import models, runs, synth
from tabulon.plans.queries.access import NUMBER_TEXT
from tabulon.plans.queries.base import CATEGORICAL, ENTRY_TYPES_BY_NAME, NUMERIC, Tables, query, rounded, union_all
from tabulon.plans.queries.cleaning import nonblank
from tabulon.sources.catalog import extend

# ---- synthetic rows ---------------------------------------------------------

def _gen_sql() -> str:
    numeric = [
        f"""SELECT '{c}' AS "column", '{ENTRY_TYPES_BY_NAME[c]}' AS dtype, 'numeric' AS type, coalesce(CAST(min({c}) AS DOUBLE), 0) AS min,
            coalesce(CAST(max({c}) AS DOUBLE), 0) AS max, round(coalesce(avg(CAST({c} AS DOUBLE)), 0), 4) AS mean,
            round(coalesce(stddev_samp(CAST({c} AS DOUBLE)), 0), 4) AS std, NULL AS category, NULL AS prob, NULL AS unique_count FROM entries"""
        for c in NUMERIC
    ]
    categorical = [
        f"""SELECT * FROM (SELECT '{c}', '{ENTRY_TYPES_BY_NAME[c]}', 'categorical', NULL, NULL, NULL, NULL, CAST({c} AS VARCHAR), round(count(*) / (SELECT count({c}) FROM entries), 8),
            (SELECT count(DISTINCT {c}) FROM entries) FROM entries WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 50)"""
        for c in CATEGORICAL
    ]
    return union_all(numeric + categorical)


@query("gen_schema", _gen_sql())
def _(t: Tables):
    return rounded(rounded(synth.generator_schema(t.entries), 4, "mean", "std"), 8, "prob")


@query("gen_rows")
def _(t: Tables):
    base = t.entries
    return synth.generate(base, base.count(), 0.05, 7)


@query("gen_extend")
def _(t: Tables):
    base = t.entries
    return extend(base, synth.generate(base, base.count(), seed=11)).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


# ---- feature preparation ----------------------------------------------------

LIKE = ["funding_usd", "population_served", "numeric_text", "date_text", "region", "all_null_num"]
NO_COMMA = NUMBER_TEXT.replace("numeric_text", "replace(numeric_text, ',', '')")


def _like_sql(c: str) -> str:
    number = NUMBER_TEXT.replace("trim(numeric_text)", f"trim(replace(CAST({c} AS VARCHAR), ',', ''))")
    return f"""SELECT '{c}' AS "column", ratio, ratio >= 0.85 AS numeric_like FROM (SELECT coalesce(count({number}) / nullif(count({c}), 0)::DOUBLE, 0) AS ratio FROM entries)"""


@query("numeric_like", "SELECT \"column\", round(ratio, 8) AS ratio, numeric_like FROM (" + union_all(_like_sql(c) for c in LIKE) + ")")
def _(t: Tables):
    return rounded(f.numeric_like(t.entries, LIKE), 8)


@query("target_clean", f"SELECT row_id, {NO_COMMA} AS numeric_text FROM entries WHERE {NO_COMMA} IS NOT NULL")
def _(t: Tables):
    return f.clean_target(t.entries.select("row_id", "numeric_text"), "numeric_text")


IMPUTED = ["funding_usd", "numeric_text", "all_null_num", "nexus_focus", "policy_type"]


@query(
    "feature_impute",
    f"""SELECT row_id, coalesce(funding_usd, (SELECT median(funding_usd) FROM entries)) AS funding_usd, coalesce({NO_COMMA}, (SELECT quantile_cont({NO_COMMA}, 0.5) FROM entries)) AS numeric_text,
        'unknown' AS all_null_num, coalesce({nonblank('nexus_focus')}, 'unknown') AS nexus_focus,
        coalesce({nonblank('policy_type')}, 'not_policy') AS policy_type FROM entries""",
)
def _(t: Tables):
    return f.impute_features(t.entries.select("row_id", *IMPUTED), IMPUTED)


@query(
    "label_encode",
    """SELECT row_id, region, dense_rank() OVER (ORDER BY region) - 1 AS region_code,
       dense_rank() OVER (ORDER BY abstract_summary) - 1 AS abstract_summary_code FROM entries""",
)
def _(t: Tables):
    return f.label_encode(t.entries.select("row_id", "region", "abstract_summary"), ["region", "abstract_summary"]).drop("abstract_summary")


KINDS = ["Patent", "Policy", "Project", "Publication"]


@query("one_hot", "SELECT row_id, " + ", ".join(f"CASE WHEN entry_type = '{k}' THEN 1e0 ELSE 0e0 END AS \"entry_type_{k}\"" for k in KINDS) + " FROM entries")
def _(t: Tables):
    return f.one_hot(t.entries.select("row_id", "entry_type"), ["entry_type"])


@query("onehot", "SELECT 2e0 AS ones, count(*) AS n FROM entries WHERE region IS NOT NULL AND sector IS NOT NULL")
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    columns = ["region", "sector", "impact_score"]
    model = f.fit_features(t.entries, columns)
    vectors = model.transform(t.entries.select("row_id", *columns))
    flags = F.slice(vector_to_array("features"), len(model.numeric) + 1, len(model.names))
    ones = F.aggregate(flags, F.lit(0.0), lambda a, v: a + v).alias("ones")
    return vectors.select(ones).groupBy("ones").agg(F.count(F.lit(1)).alias("n"))


SCALED = ["impact_score", "innovation_index", "funding_usd", "constant_num"]


def _scale_sql(centre: str, spread: str) -> str:
    cells = ", ".join(
        f"round(({c} - (SELECT {centre.format(c=c)} FROM entries)) / coalesce(nullif((SELECT {spread.format(c=c)} FROM entries), 0), 1), 8) + 0.0 AS {c}"
        for c in SCALED
    )
    return f"SELECT row_id, {cells} FROM entries"


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def _(t: Tables):
    return rounded(f.scale(t.entries.select("row_id", *SCALED), SCALED, "standard"), 8)


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def _(t: Tables):
    return rounded(f.scale(t.entries.select("row_id", *SCALED), SCALED, "minmax"), 8)


@query("scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def _(t: Tables):
    return rounded(f.scale(t.entries.select("row_id", *SCALED), SCALED, "robust"), 8)


@query("split")
def _(t: Tables):
    train, test = f.split(t.entries.select("row_id"), "row_id")
    size = lambda d, name: d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return size(train, "train").union(size(test, "test"))


# ---- regression -------------------------------------------------------------


@query(
    "fit_linear",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""",
)
def _(t: Tables):
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label"))
    )
    model = models.MODELS["Linear Regression"].fit({}, rows)
    fitted = t.spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return rounded(fitted, 4)


@query(
    "fit_ridge_single",
    """SELECT round(regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 5000), 4) AS slope,
       round(avg(l_extendedprice) - regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 5000) * avg(l_quantity), 4) AS intercept
       FROM lineitem""",
)
def _(t: Tables):
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label"))
    )
    model = models.MODELS["Ridge Regression"].fit({"alpha": 5000.0}, rows)
    fitted = t.spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return rounded(fitted, 4)


FEATURES = ["year", "region", "sector", "status", "entry_type", "investment_roi", "population_served", "innovation_index", "numeric_text", "nexus_focus"]


def _prepared(t: Tables) -> models.Prepared:
    return models.prepare(t.entries, "impact_score", FEATURES, "row_id")


def _fit_query(name: str, model: str, params: dict | None = None):
    @query(name)
    def _(t: Tables):
        return models.train_model(_prepared(t), model, params).metrics()


_fit_query("fit_ridge", "Ridge Regression")
_fit_query("fit_tree", "Decision Tree")
_fit_query("fit_forest", "Random Forest", models.MODEL_CONFIG["models"]["Random Forest"])
_fit_query("fit_gbt", "Gradient Boosting", models.MODEL_CONFIG["models"]["Gradient Boosting"])
_fit_query("fit_voting", "Ensemble (Voting)")


@query("fit_cluster_mean")
def _(t: Tables):
    prepared = _prepared(t)
    trained = models.train_model(prepared, "K-Means Clustering", models.MODEL_CONFIG["models"]["K-Means Clustering"])
    extra = {"inertia": F.lit(trained.model.inertia), "silhouette": F.lit(trained.model.silhouette(prepared.train))}
    return trained.metrics().withColumns(extra)


@query(
    "regression_metrics",
    """SELECT l_returnflag, count(*) AS n, round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
       round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 8) AS r2
       FROM (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS m FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500e0 AS p FROM lineitem)) GROUP BY 1""",
)
def _(t: Tables):
    pairs = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))
    out = models.regression_metrics(pairs, by=["l_returnflag"])
    return rounded(rounded(rounded(out, 2, "mse"), 4, "rmse", "mae"), 8, "r2")


@query("cv_r2")
def _(t: Tables):
    return models.cv_r2(_prepared(t), "Linear Regression", 5)


@query(
    "cv_moments",
    """WITH r AS (SELECT l_orderkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    s AS (SELECT fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM r GROUP BY fold),
    o AS (SELECT a.fold, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM s a JOIN s b ON b.fold <> a.fold GROUP BY a.fold),
    m AS (SELECT fold, (xy - x * y / n) / (xx - x * x / n) AS slope, x / n AS mx, y / n AS my FROM o)
    SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(1 - avg((y - my - slope * (x - mx)) ** 2) / var_pop(y), 8) AS r2 FROM r JOIN m USING (fold) GROUP BY fold""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", array_to_vector(F.array("l_quantity")).alias("features"), F.col("l_extendedprice").alias("label"))
    return rounded(models.moment_cv(rows, F.col("l_orderkey") % 5), 8, "r2")


@query("feature_importance")
def _(t: Tables):
    return models.train_model(_prepared(t), "Decision Tree").feature_importance()


@query("residuals")
def _(t: Tables):
    return models.train_model(_prepared(t), "Linear Regression").residuals()


@query("score_raw")
def _(t: Tables):
    trained = models.train_model(_prepared(t), "Linear Regression")
    raw = t.entries.select("row_id", "year", F.lit("Nowhere").alias("region"), "sector", "investment_roi")
    return trained.score(raw).select("row_id", "prediction")


@query("train_all_models")
def _(t: Tables):
    rows = models.train_all_models(t.entries, "impact_score", "row_id", {**models.MODEL_CONFIG["models"], "Not There": {}})
    flat = [(r["model_name"], r["target_col"], (r.get("test_metrics") or {}).get("r2"), r.get("error")) for r in rows]
    return t.spark.createDataFrame(flat, "model_name string, target_col string, r2 double, error string")


# ---- run results ------------------------------------------------------------

# Orders seen as stored runs: several runs per model and target, some without
# target, metrics or features.
RUN_SQL = """SELECT o_orderkey AS k, 'RES-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE o_orderkey % 5 WHEN 0 THEN 'time_series' WHEN 1 THEN 'nlp' WHEN 2 THEN 'nexus_insights' WHEN 3 THEN 'sdg_analysis' ELSE 'ml_model' END AS run_type,
  'model ' || CAST(o_custkey % 7 AS VARCHAR) AS model_name, CASE WHEN o_orderkey % 13 <> 0 THEN 'total_' || lower(o_orderpriority) END AS target_col,
  'cleaned' AS dataset, o_custkey AS train_size, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS rmse,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 END AS r2, CAST(o_orderkey % 4 AS INT) AS feature_count FROM orders"""


def _runs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    types = F.array(*[F.lit(x) for x in ("time_series", "nlp", "nexus_insights", "sdg_analysis", "ml_model")])
    metrics = F.map_filter(
        F.create_map(
            F.lit("rmse"), F.when(k % 11 != 0, F.col("o_totalprice")),
            F.lit("r2"), F.when((k % 11 != 0) & (k % 3 != 0), (F.col("o_custkey") % 100).cast("double") / 100),
        ),
        lambda _, v: v.isNotNull(),
    )
    return t.orders.select(
        F.concat(F.lit("RES-"), F.lpad(k.cast("string"), 9, "0")).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.get(types, (k % 5).cast("int")).alias("run_type"),
        F.concat(F.lit("model "), (F.col("o_custkey") % 7).cast("string")).alias("model_name"),
        F.when(k % 13 != 0, F.concat(F.lit("total_"), F.lower("o_orderpriority"))).alias("target_col"),
        F.lit("cleaned").alias("dataset"),
        F.col("o_custkey").alias("train_size"),
        F.when(k % 11 != 0, metrics).alias("test_metrics"),
        F.array_repeat(F.lit("x"), (k % 4).cast("int")).alias("feature_cols"),
    )


@query("results_by_target", f"WITH runs AS ({RUN_SQL}) SELECT coalesce(target_col, 'unknown') AS target_col, id, model_name, run_type, train_size, feature_count FROM runs")
def _(t: Tables):
    return runs.results_by_target(_runs(t)).select("target_col", "id", "model_name", "run_type", "train_size", "feature_count")


@query(
    "results_by_model",
    f"""WITH runs AS ({RUN_SQL}) SELECT model_name, coalesce(target_col, 'unknown') AS target_col, max(id) AS id, arg_max(train_size, id) AS train_size,
        arg_max(feature_count, id) AS feature_count FROM runs GROUP BY 1, 2""",
)
def _(t: Tables):
    return runs.results_by_model(_runs(t)).select("model_name", "target_col", "id", "train_size", "feature_count")


@query(
    "metric_keys",
    f"WITH runs AS ({RUN_SQL}) SELECT 'rmse' AS metric FROM runs WHERE rmse IS NOT NULL UNION SELECT 'r2' FROM runs WHERE r2 IS NOT NULL",
)
def _(t: Tables):
    return runs.metric_keys(_runs(t))


@query("available_comparisons", f"WITH runs AS ({RUN_SQL}) SELECT id, model_name, run_type, target_col, timestamp, dataset, train_size FROM runs")
def _(t: Tables):
    return runs.available_comparisons(_runs(t))


CHOSEN = [f"RES-{k:09d}" for k in (1, 3, 11, 14, 100)]
_ids = ", ".join(f"'{i}'" for i in CHOSEN)


@query(
    "compare_runs",
    f"""WITH runs AS ({RUN_SQL}), long AS (SELECT id, model_name, target_col, 'r2' AS metric, r2 AS value FROM runs UNION ALL
        SELECT id, model_name, target_col, 'rmse', rmse FROM runs) SELECT * FROM long WHERE value IS NOT NULL AND id IN ({_ids})""",
)
def _(t: Tables):
    return runs.compare_runs(_runs(t), CHOSEN, ["r2", "rmse", "mae"])


@query("latest_runs", f"WITH runs AS ({RUN_SQL}) SELECT run_type, id, timestamp FROM runs QUALIFY row_number() OVER (PARTITION BY run_type ORDER BY timestamp DESC, id DESC) = 1")
def _(t: Tables):
    return runs.latest_runs(_runs(t)).select("run_type", "id", "timestamp")


@query("last_trained", f"WITH runs AS ({RUN_SQL}) SELECT max(timestamp) AS last_trained FROM runs")
def _(t: Tables):
    return runs.last_trained(_runs(t))


@query("run_counts", f"WITH runs AS ({RUN_SQL}) SELECT run_type, count(*) AS count FROM runs GROUP BY 1")
def _(t: Tables):
    return runs.run_counts(_runs(t))


@query(
    "metric_table",
    f"""WITH runs AS ({RUN_SQL}) SELECT id, replace(target_col, '_', ' ') AS name, coalesce(r2, 0) AS r2, coalesce(rmse, 0) AS rmse, 0e0 AS mae
        FROM runs WHERE run_type = 'ml_model'""",
)
def _(t: Tables):
    return runs.metric_table(_runs(t))
