import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import features as f
from tabulon.operators import models, text


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        a, b, kind = float(rng.normal()), float(rng.normal() * 10), ["p", "q", "r"][i % 3]
        y = 3 * a - 0.5 * b + {"p": 0.0, "q": 5.0, "r": -5.0}[kind] + 7
        rows.append((i, a if i % 50 else None, f"{b:,.6f}" if i % 40 else "n/a", kind if i % 33 else " ", f"{y:.6f}"))
    return spark.createDataFrame(rows, "id int, a double, b string, kind string, y string").persist()


@pytest.fixture(scope="module")
def prepared(planted):
    return models.prepare(planted, "y", ["a", "b", "kind"], "id")


def metric(trained, name, part="test"):
    return trained.metrics(part).first()[name]


def test_classes(planted):
    got = {r["column"]: (round(r["ratio"], 3), r["numeric_like"]) for r in f.numeric_like(planted, ["a", "b", "kind"]).collect()}
    assert got == {"a": (1.0, True), "b": (0.975, True), "kind": (0.0, False)}


def test_target(spark):
    few = spark.createDataFrame([(i, "1,000") for i in range(9)] + [(99, "x")], "id int, y string")
    with pytest.raises(ValueError):
        f.clean_target(few, "y")
    assert f.clean_target(few, "y", check=False).agg(F.sum("y")).first()[0] == 9000.0


def test_split_is_stable(planted):
    train, test = f.split(planted, "id")
    again = f.split(planted.repartition(7), "id")[1]
    assert train.count() + test.count() == 600 and 80 < test.count() < 160
    assert {r["id"] for r in test.collect()} == {r["id"] for r in again.collect()}


def test_planted_relation(prepared):
    linear = models.train_model(prepared, "Linear Regression")
    assert metric(linear, "r2") > 0.9
    top = linear.feature_importance().first()["feature"]
    assert top in ("kind_q", "kind_r", "b")
    for name, params, low in (
        ("Decision Tree", {}, 0.6), ("Random Forest", {"n_estimators": 10}, 0.6), ("Gradient Boosting", {"n_estimators": 10}, 0.6),
        ("Ensemble (Voting)", {"n_estimators": 5}, 0.6), ("K-Means Clustering", {"n_init": 2}, 0.0),
    ):
        assert metric(models.train_model(prepared, name, params), "r2") > low, name
    with pytest.raises(KeyError):
        models.train_model(prepared, "nope")


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2)) * [1, 5]
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=80)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, label double")
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = models.MODELS["Ridge Regression"].fit({"alpha": 20.0}, rows)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 20 * np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)


def test_features_come_from_training_rows(prepared, spark):
    raw = spark.createDataFrame([("zzz",)], "kind string")
    row = prepared.features.transform(raw, absent="zero").select(vector_to_array("features").alias("v")).first()["v"]
    names = prepared.features.names
    assert names[:2] == ["a", "b"] and sorted(names[2:]) == ["kind_p", "kind_q", "kind_r", "kind_unknown"]
    centre, spread = prepared.features.constants["b"]
    assert row[1] == pytest.approx(-centre / spread) and row[2:] == [0.0] * 4


def test_codes(planted):
    model = f.fit_features(planted, ["a", "kind"], "none", encode=False)
    got = model.transform(planted).select("kind", vector_to_array("features")[1].alias("code")).distinct().collect()
    assert {r["kind"]: r["code"] for r in got} == {"p": 0.0, "q": 1.0, "r": 2.0, " ": 3.0}


def test_one_hot_unseen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    got = [tuple(r) for r in f.one_hot(df, ["k"], {"k": ["a"]}).orderBy("id").collect()]
    assert got == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_metrics(spark):
    rows = [("perfect", 1.0, 1.0), ("perfect", 2.0, 2.0), ("biased", 1.0, 2.0), ("biased", 3.0, 4.0), ("flat", 5.0, 4.0), ("flat", 5.0, 6.0), ("exact", 5.0, 5.0)]
    got = {r["g"]: r for r in models.regression_metrics(spark.createDataFrame(rows, "g string, y double, p double"), "y", "p", ["g"]).collect()}
    assert got["perfect"]["r2"] == 1.0 and got["biased"]["r2"] == 0.0 and got["flat"]["r2"] == 0.0 and got["exact"]["r2"] == 1.0
    assert got["biased"]["rmse"] == got["biased"]["mae"] == 1.0


def test_cross_validation(prepared):
    rows = models.cv_r2(prepared, "Linear Regression", 3).collect()
    assert [r["fold"] for r in rows] == [0, 1, 2] and all(r["r2"] > 0.9 for r in rows)


def test_residuals_and_scoring(prepared, planted):
    trained = models.train_model(prepared, "Linear Regression")
    rows = trained.residuals()
    assert rows.columns == ["id", "actual", "predicted", "residual"] and rows.count() == prepared.test.count()
    assert trained.score(planted.drop("a")).where("prediction IS NULL").count() == 0


def test_train_all(planted):
    df = planted.withColumn("noise", F.col("id").cast("string")).withColumn("b", F.expr("try_cast(replace(b, ',', '') AS double)"))
    records = models.train_all_models(df, "y", "id", {"Linear Regression": {}, "Broken": {}})
    assert [r["model_name"] for r in records] == ["Linear Regression", "Broken"]
    assert "noise" not in " ".join(records[0]["feature_cols"]) and records[0]["test_metrics"]["r2"] > 0.9
    assert "error" in records[1]
    with pytest.raises(ValueError):
        f.select_features(planted.select("y", "a"), "y")


def test_targets(planted):
    assert models.trainable_targets(planted.withColumn("year", F.lit(1))) == ["id", "a", "b", "kind", "y"]


@pytest.fixture(scope="module")
def docs(spark):
    solar, water = "solar grid battery storage wind output", "river basin flood water level sensor"
    rows = [(i, (solar if i % 2 else water) + f" item{i % 7} The END!", "north" if i % 2 else "south") for i in range(120)]
    rows += [(900, "too short", "north"), (901, None, "south"), (902, "word " * 501, "north")]
    return spark.createDataFrame(rows, "id int, text string, region string")


def test_corpus(docs):
    corpus = text.corpus(docs, "id", ["text"], keep=["region"])
    assert corpus.count() == 120
    assert corpus.orderBy("id").first()["text"] == "river basin flood water level sensor item0 the end"
    with pytest.raises(ValueError):
        text.corpus(docs, "id", ["nope"])
    with pytest.raises(ValueError):
        text.tfidf(corpus.limit(10))


def test_idf(docs):
    corpus = text.corpus(docs, "id", ["text"])
    terms = {r["term"]: r for r in text.tfidf_terms(text.with_terms(corpus, ["the"]), 120).collect()}
    assert terms["solar"]["df"] == 60 and terms["solar"]["idf"] == pytest.approx(np.log(121 / 61) + 1)
    assert "solar grid" in terms and "the" not in terms and "end" not in terms  # in all documents


def test_topics_and_clusters(docs):
    features = text.tfidf(text.corpus(docs, "id", ["text"], keep=["region"]))
    norm = features.frame.select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v * v).alias("n"))
    assert norm.agg(F.min("n"), F.max("n")).first()[0] == pytest.approx(1.0)
    model = text.fit_topics(features, k=2)
    shares = text.topic_distribution(model, features, 2).collect()
    assert sum(r["doc_count"] for r in shares) == 120 and [r["topic"] for r in shares] == [1, 2]
    assert text.topic_terms(model, features, 3).count() == 6
    assigned = text.assign_clusters(text.fit_clusters(features, restarts=2), features)
    profile = text.cluster_profile(assigned, features, "region").collect()
    assert sum(r["size"] for r in profile) == 120
    named = {r["cluster_name"]: r for r in profile}
    assert "Renewable Energy Optimization" in named and named["Renewable Energy Optimization"]["top_regions"] == ["north"]
    assert all(len(r["top_terms"]) == 5 and r["cluster_name"] in r["description"] for r in profile)
    features.unpersist()


def test_cluster_rules(spark):
    rows = [(["Pilot", "x"],), (["sensors", "grid"],), (["nothing", "here"],)]
    rows += [([keys[-1]],) for _, keys in text.CLUSTER_RULES]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(text.cluster_label(F.col("t"))).collect()]
    assert got[:3] == ["Pilot Deployments & Feasibility", "Real-Time IoT Monitoring", "Nexus Innovation (Nothing)"]
    assert got[3:] == [title for title, _ in text.CLUSTER_RULES]


def test_extremes(spark):
    counts = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 5)], "topic int, doc_count bigint")
    assert tuple(text.topic_extremes(counts).first()) == (2, 9, 4, 5)


def test_members_of_the_vote_are_fitted_once(planted, monkeypatch):
    fitted = []
    monkeypatch.setattr(models, "fit_perceptron", lambda train, seed, fit=models.fit_perceptron: fit(train, epochs=2, seed=seed))
    for kind in (models.RandomForestRegressor, models.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, train, name=kind.__name__, fit=kind.fit: fitted.append(name) or fit(self, train))
    forest, boosting = {"n_estimators": 3, "max_depth": 4, "min_samples_leaf": 4}, {"n_estimators": 3, "max_depth": 4}
    both = {"Random Forest": forest, "Gradient Boosting": boosting, "Ensemble (Voting)": {"n_estimators": 3, "max_depth": 4}}
    records = models.train_all_models(planted, "y", "id", both)
    assert fitted == ["RandomForestRegressor", "GBTRegressor"] and not any("error" in r for r in records)
    # the shared members are those that the model fits by itself
    alone = models.train_all_models(planted, "y", "id", {"Ensemble (Voting)": both["Ensemble (Voting)"]})
    assert alone[0]["test_metrics"] == records[2]["test_metrics"] and len(fitted) == 4
    # other parameters are other models
    fitted.clear()
    models.train_all_models(planted, "y", "id", {"Random Forest": forest, **{"Ensemble (Voting)": {"n_estimators": 2, "max_depth": 4}}})
    assert len(fitted) == 3


def test_training_queries_read_all_columns(tables, spark, monkeypatch):
    from tabulon.plans.queries import QUERIES
    from tabulon.plans.queries.base import ENTRY_COLUMNS
    from tests.conftest import SMALL

    seen = []
    monkeypatch.setattr(models, "train_all_models", lambda df, target, key, *rest: seen.append((df.columns, target, key)) or [])
    for name in ("train_all_models", "trained_models"):
        QUERIES[name](spark, SMALL)
    assert seen == [([c for c, _ in ENTRY_COLUMNS], "impact_score", "row_id")] * 2
    chosen = f.select_features(tables.entries, "impact_score")
    assert {"month", "country", "funding_usd", "open_access", "date_text", "constant_num"} <= set(chosen)
    assert not {"entry_id", "title", "abstract_summary", "organization", "entry_ts"} & set(chosen)


def test_times_are_categories_up_to_the_same_number(spark):
    df = spark.range(200).selectExpr("id", "id * 2e0 AS y", "timestamp_millis(id * 1000) AS at", "date_add(DATE'2024-01-01', CAST(id % 50 AS INT)) AS day", "id % 2 = 0 AS even")
    assert f.select_features(df, "y") == ["id", "day", "even"]
    assert f.select_features(df, "y", 49) == ["id", "even"]


def test_features_are_learnt_from_a_copy(planted, monkeypatch):
    runs = planted.sparkSession.sparkContext.accumulator(0)
    touched = F.udf(lambda v: runs.add(1) or v, "double")
    got = models.prepare(planted.withColumn("a", touched("a").cast("double")), "y", ["a", "b", "kind"], "id")
    assert got.train.count() + got.test.count() == 600 and runs.value == 600
    got.unpersist()


def test_fits_run_side_by_side(planted, monkeypatch):
    import threading

    both = threading.Barrier(2, timeout=60)
    for kind in (models.RandomForestRegressor, models.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, train, fit=kind.fit: both.wait() >= 0 and fit(self, train))
    monkeypatch.setattr(models, "fit_perceptron", lambda train, seed, fit=models.fit_perceptron: fit(train, epochs=1, seed=seed))
    records = models.train_all_models(planted, "y", "id", {"Ensemble (Voting)": {"n_estimators": 2, "max_depth": 3}})
    assert not any("error" in r for r in records)
