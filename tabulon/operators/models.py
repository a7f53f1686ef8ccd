"""Regression models on prepared features, their metrics and comparisons."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.features import FeatureModel, clean_target, enough_rows, fit_features, select_features, split
from tabulon.operators.kmeans import fit_kmeans
from tabulon.operators.perceptron import fit_perceptron
from tabulon.schema import ref, require
from tabulon.session import checkpointed, spread, use_checkpoints

SEED = 42


class ClusterMean:
    """Predicts the mean target of the cluster a row falls into."""

    def __init__(self, model, means: dict[int, float], overall: float):
        self.model, self.means, self.overall = model, means, overall

    @property
    def inertia(self) -> float:
        return self.model.cost

    def silhouette(self, frame: DataFrame) -> float:
        return ClusteringEvaluator().evaluate(self.model.transform(frame))

    def transform(self, frame: DataFrame) -> DataFrame:
        means = F.create_map(*[F.lit(part) for pair in self.means.items() for part in pair])
        cluster = self.model.transform(frame).withColumnRenamed("prediction", "cluster")
        return cluster.withColumn("prediction", F.coalesce(F.try_element_at(means, F.col("cluster")), F.lit(self.overall)))


class Voting:
    """Mean of the predictions of several models."""

    def __init__(self, members: Sequence):
        self.members = list(members)

    def transform(self, frame: DataFrame) -> DataFrame:
        names = [f"__vote_{i}" for i in range(len(self.members))]
        for name, member in zip(names, self.members):
            frame = member.transform(frame).withColumnRenamed("prediction", name)
        return frame.withColumn("prediction", sum(map(F.col, names)) / len(names)).drop(*names)


class Fits:
    """Models fitted on one training table, by estimator and parameters: equal ones, also as
    members of a voting model, are fitted once. Those that are begun run side by side, so that
    the short jobs of one fill the cores that another leaves idle; none depends on the others."""

    def __init__(self, train: DataFrame):
        self.train, self.known, self.pool = train, {}, ThreadPoolExecutor(4)

    def begin(self, estimator) -> Future:
        key = type(estimator), frozenset((p.name, repr(v)) for p, v in estimator.extractParamMap().items())
        if key not in self.known:
            self.known[key] = self.pool.submit(inheritable_thread_target(self.train.sparkSession)(lambda: estimator.fit(self.train)))
        return self.known[key]

    def fit(self, estimator):
        return self.begin(estimator).result()


def _linear(params: Mapping, train: DataFrame):
    return LinearRegression(labelCol="label", fitIntercept=params.get("fit_intercept", True)).fit(train)


def _ridge(params: Mapping, train: DataFrame):
    # Spark penalises on the scale of the standardised label and per row.
    row = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("std")).first()
    strength = params.get("alpha", 2.0) * (row["std"] or 1.0) / max(row["n"], 1)
    return LinearRegression(labelCol="label", elasticNetParam=0.0, regParam=strength, standardization=False).fit(train)


def _tree(params: Mapping, train: DataFrame):
    return DecisionTreeRegressor(labelCol="label", maxDepth=params.get("max_depth", 10), seed=SEED).fit(train)


def _forest_of(params: Mapping) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol="label", numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 10),
        minInstancesPerNode=params.get("min_samples_leaf", 1), seed=SEED,
    )


def _boosting_of(params: Mapping) -> GBTRegressor:
    return GBTRegressor(
        labelCol="label", maxIter=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 5),
        stepSize=params.get("learning_rate", 0.1), seed=SEED,
    )


def _members_of(params: Mapping) -> list:
    return [_forest_of({"max_depth": 10, "min_samples_leaf": 4, **params}), _boosting_of({"max_depth": 4, **params})]


def _forest(params: Mapping, train: DataFrame, fits: Fits | None = None):
    return (fits or Fits(train)).fit(_forest_of(params))


def _boosting(params: Mapping, train: DataFrame, fits: Fits | None = None):
    return (fits or Fits(train)).fit(_boosting_of(params))


def _cluster_mean(params: Mapping, train: DataFrame):
    k, restarts = params.get("n_clusters", 5), params.get("n_init", 10)
    model = fit_kmeans(train, k, [SEED + i for i in range(restarts)])
    rows = model.transform(train).groupBy("prediction").agg(F.avg("label").alias("mean"), F.count("label").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return ClusterMean(model, {r["prediction"]: r["mean"] for r in rows}, sum(r["mean"] * r["n"] for r in rows) / total)


def _voting(params: Mapping, train: DataFrame, fits: Fits | None = None):
    fits = fits or Fits(train)
    begun = [fits.begin(member) for member in _members_of(params)]
    perceptron = fit_perceptron(train, seed=SEED)
    return Voting([*[member.result() for member in begun], perceptron])


#: What can be begun ahead of the models that need it.
BEGUN = {_forest: lambda params: [_forest_of(params)], _boosting: lambda params: [_boosting_of(params)], _voting: _members_of}


@dataclass(frozen=True)
class ModelKind:
    name: str
    category: str
    fit: Callable
    defaults: Mapping


MODELS = {
    kind.name: kind
    for kind in [
        ModelKind("Linear Regression", "regression", _linear, {"fit_intercept": True}),
        ModelKind("Ridge Regression", "regression", _ridge, {"alpha": 2.0}),
        ModelKind("Decision Tree", "regression", _tree, {"max_depth": 10}),
        ModelKind("Random Forest", "regression", _forest, {"n_estimators": 100, "max_depth": 10}),
        ModelKind("Gradient Boosting", "regression", _boosting, {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1}),
        ModelKind("K-Means Clustering", "clustering", _cluster_mean, {"n_clusters": 5, "n_init": 10}),
        ModelKind("Ensemble (Voting)", "regression", _voting, {}),
    ]
}

# The shipped training configuration.
MODEL_CONFIG = {
    "dataset": "cleaned",
    "exclude_targets": [
        "entry_id", "title", "abstract_summary", "keywords", "language", "dataset_used", "publication_venue",
        "model_performance_metric", "model_performance_value", "open_access", "patent_class", "policy_type",
        "policy_level", "policy_stringency_score", "year", "month", "patent_family_size", "venue_h_index",
        "population_served", "citation_count", "impact_score", "innovation_index", "renewable_energy_share_pct",
    ],
    "models": {
        "Linear Regression": {},
        "Decision Tree": {"max_depth": 8},
        "Random Forest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 4},
        "Gradient Boosting": {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.1},
        "Ensemble (Voting)": {},
        "K-Means Clustering": {"n_clusters": 3},
    },
}


def trainable_targets(df: DataFrame, config: Mapping = MODEL_CONFIG) -> list[str]:
    return [c for c in df.columns if c not in config["exclude_targets"]]


def regression_metrics(df: DataFrame, y: str = "label", yhat: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae and r2 in one pass. With a constant target r2 is 1 for a
    perfect prediction, else 0."""
    require(df, y, yhat, *by)
    pairs = df.select(*[ref(c) for c in by], ref(y).cast("double").alias("__y"), ref(yhat).cast("double").alias("__p")).dropna(subset=["__y", "__p"])
    error = F.col("__y") - F.col("__p")
    grouped = pairs.groupBy(*[ref(c) for c in by]).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("__y").alias("__var"), F.count("__y").alias("n")
    )
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("__var") > 0, 1.0 - F.col("mse") / F.nullif(F.col("__var"), F.lit(0.0))).otherwise(flat)
    return grouped.select(*[ref(c) for c in by], "n", "mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("n") > 0, r2).alias("r2"))


@dataclass
class Prepared:
    """Train and test rows with ``features`` and ``label``, kept for the models."""

    features: FeatureModel
    train: DataFrame
    test: DataFrame
    target: str
    key: str

    def unpersist(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def prepare(
    df: DataFrame, target: str, columns: Sequence[str], key: str, method: str = "standard", encode: bool = True, test_share: float = 0.2
) -> Prepared:
    """Clean the target, split by key, learn features on the training part.

    What the features are learnt from is read many times, from a copy in the shared folder.
    """
    require(df, key, *columns)
    use_checkpoints(df.sparkSession)  # boosting cuts its lineage there
    rows = clean_target(df.select(ref(key).alias("__key"), ref(target).alias("__label"), *[ref(c) for c in columns if c != target]), "__label", check=False)
    rows = checkpointed(rows)
    enough_rows(rows, "__label")
    model = fit_features(split(rows, "__key", test_share, SEED)[0], columns, method, encode)
    train, test = split(spread(rows, "__key", rows.count()), "__key", test_share, SEED)
    vectors = lambda d: model.transform(d.select(ref("__key").alias("key"), ref("__label").alias("label"), *[ref(c) for c in columns]))
    keep = lambda d: vectors(d).select("key", "label", "features").persist()
    return Prepared(model, keep(train), keep(test), target, key)


@dataclass
class Trained:
    """A fitted model with the data it was fitted on."""

    name: str
    params: Mapping
    model: object
    prepared: Prepared
    seconds: float

    def predictions(self, part: str = "test") -> DataFrame:
        return self.model.transform(getattr(self.prepared, part)).select("key", "label", "prediction")

    def metrics(self, part: str = "test") -> DataFrame:
        return regression_metrics(self.predictions(part))

    def residuals(self, part: str = "test") -> DataFrame:
        rows = self.predictions(part).withColumn("residual", F.col("label") - F.col("prediction"))
        return rows.withColumnsRenamed({"key": self.prepared.key, "label": "actual", "prediction": "predicted"})

    def feature_importance(self) -> DataFrame:
        """``(feature, importance)`` by absolute value; linear models give coefficients."""
        values = getattr(self.model, "featureImportances", None)
        values = getattr(self.model, "coefficients", None) if values is None else values
        if values is None:
            raise ValueError(f"{self.name} has no feature importance")
        spark = self.prepared.train.sparkSession
        rows = list(zip(self.prepared.features.names, [float(v) for v in values.toArray()]))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc(F.abs("importance")), "feature")

    def score(self, rows: DataFrame) -> DataFrame:
        """Raw rows with a ``prediction``; missing numbers are 0, unseen categories nothing."""
        return self.model.transform(self.prepared.features.transform(rows, absent="zero")).drop("features")


def train_model(prepared: Prepared, name: str, params: Mapping | None = None, fits: Fits | None = None) -> Trained:
    """``fits`` holds what was already begun on the training rows of ``prepared``; only the wait for it takes time."""
    if name not in MODELS:
        raise KeyError(f"unknown model {name}; known: {sorted(MODELS)}")
    kind = MODELS[name]
    params = {**kind.defaults, **(params or {})}
    started = time.time()
    shared = {"fits": fits} if fits and kind.fit in BEGUN else {}
    model = kind.fit(params, prepared.train, **shared)
    return Trained(name, params, model, prepared, time.time() - started)


def fold(key: Column, folds: int, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit("fold")), F.lit(folds))


#: Linear models with at most so many features are cross-validated from their moments.
MOMENT_FEATURES = 300


def fold_moments(rows: DataFrame, place: Column) -> dict[int, np.ndarray]:
    """Per fold the sum of ``v v'`` over its rows, where ``v`` is 1, the features and the label.

    One pass: each task adds up matrix products over Arrow batches and passes one
    matrix a fold on. Features and label are taken from those of one row, which keeps
    the sums of far-off columns exact.
    """
    cells = rows.select(place.cast("int").alias("fold"), F.array_append(vector_to_array("features"), F.col("label")).alias("v"))
    first = cells.first()
    if first is None:
        return {}
    origin = np.array(first["v"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch["v"].flatten().to_numpy().reshape(len(batch), -1) - origin
            v = np.hstack([np.ones((len(v), 1)), v])
            place = batch["fold"].to_numpy()
            for i in np.unique(place):
                mine = v[place == i]
                sums[i] = sums.get(i, 0) + mine.T @ mine
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=["fold", "m"])

    size = len(origin) + 1
    parts = cells.mapInArrow(add_up, "fold int, m array<double>").select("fold", F.posexplode("m").alias("at", "x"))
    total: dict[int, np.ndarray] = {}
    for row in parts.groupBy("fold", "at").agg(F.sum("x").alias("x")).collect():
        total.setdefault(row["fold"], np.zeros(size * size))[row["at"]] = row["x"]
    return {i: m.reshape(size, size) for i, m in total.items()}


def solve_moments(m: np.ndarray, alpha: float) -> np.ndarray:
    """Weights of 1 and the features that minimise the squared error, plus ``alpha`` times
    the squared weights other than the first. Of equally good ones the shortest."""
    gram, target = m[:-1, :-1], m[:-1, -1]
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    centred = gram[1:, 1:] - n * np.outer(mean, mean) + alpha * np.eye(len(mean))
    weights = np.linalg.lstsq(centred, target[1:] - mean * target[0], rcond=None)[0]
    return np.concatenate([[target[0] / n - mean @ weights], weights])


def moment_cv(rows: DataFrame, place: Column, alpha: float = 0.0) -> DataFrame:
    """``(fold, n, r2)`` of a linear model of ``label`` by ``features`` with intercept: the
    moments of all folds but one give the model, the moments of that one its error."""
    moments = fold_moments(rows, place)
    whole = sum(moments.values()) if moments else None
    found = []
    for i, m in sorted(moments.items()):
        n = m[0, 0]
        if whole[0, 0] - n < 1:
            raise ValueError("cross-validation needs rows in two folds")
        error = np.append(-solve_moments(whole - m, alpha), 1.0)
        mse, variance = max(error @ m @ error / n, 0.0), m[-1, -1] / n - (m[0, -1] / n) ** 2
        found.append((i, int(n), float(1.0 - mse / variance) if variance > 0 else float(mse == 0)))
    return rows.sparkSession.createDataFrame(found, "fold int, n bigint, r2 double").orderBy("fold")


def cv_r2(prepared: Prepared, name: str, folds: int = 5, params: Mapping | None = None) -> DataFrame:
    """``(fold, r2)``: each fold scored by a model of the others.

    Linear models with an intercept need one pass over the rows for all folds; the
    others are fitted once a fold.
    """
    kind = MODELS[name]
    params = {**kind.defaults, **(params or {})}
    if kind.fit in (_linear, _ridge) and params.get("fit_intercept", True) and len(prepared.features.names) <= MOMENT_FEATURES:
        return moment_cv(prepared.train, fold(F.col("key"), folds), params.get("alpha", 2.0) if kind.fit is _ridge else 0.0)
    return refit_cv(prepared, kind, folds, params)


def refit_cv(prepared: Prepared, kind: ModelKind, folds: int, params: Mapping) -> DataFrame:
    """Cross-validation by a fit and a scoring for each fold."""
    place = fold(F.col("key"), folds)
    scored = None
    for i in range(folds):
        model = kind.fit(params, prepared.train.where(place != i))
        part = model.transform(prepared.train.where(place == i)).select(F.lit(i).alias("fold"), "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    return regression_metrics(scored, by=["fold"]).select("fold", "n", "r2").orderBy("fold")


def train_all_models(
    df: DataFrame, target: str, key: str, models: Mapping[str, Mapping] = MODEL_CONFIG["models"], exclude: Sequence[str] | None = None
) -> list[dict]:
    """Train every model on one prepared table. One record per model, fit for the
    result store; a failing model gives a record with its error. A forest or boosting that
    is also a member of the voting model is fitted once. These run beside the other models;
    what is timed is how long each is waited for."""
    columns = select_features(df, target, **({} if exclude is None else {"exclude": exclude}))
    columns = [c for c in columns if c != key]
    prepared = prepare(df, target, columns, key)
    sizes = {"train_size": prepared.train.count(), "test_size": prepared.test.count()}
    records, fits = [], Fits(prepared.train)
    try:
        for kind, params in ((MODELS[name], params) for name, params in models.items() if name in MODELS):
            for estimator in BEGUN.get(kind.fit, lambda _: [])({**kind.defaults, **params}):
                fits.begin(estimator)
        for name, params in models.items():
            record = {"run_type": "ml_model", "model_name": name, "target_col": target}
            try:
                trained = train_model(prepared, name, params, fits)
                for part in ("train", "test"):
                    row = trained.metrics(part).first()
                    record[f"{part}_metrics"] = {m: row[m] for m in ("rmse", "mse", "mae", "r2")}
                record |= {
                    "category": MODELS[name].category,
                    "feature_cols": list(prepared.features.names),
                    "params": dict(trained.params),
                    "training_time": round(trained.seconds, 3),
                    **sizes,
                }
            except Exception as error:
                record["error"] = str(error)
            records.append(record)
    finally:
        prepared.unpersist()
    return records
