"""Mechanisms for large tables, each held against its plain form and its work counted."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabulon.operators import kmeans, models, plots, text, topk
from tests.test_plans import plan


# ---- density by reach of the kernel

def kernel_work(spark, spread):
    rng = random.Random(3)
    rows = [("g", rng.gauss(0, 1) + (spread if i % 100 == 0 else 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double")
    cells, top = plots._kde_rows(df, "x", "g", 6)
    bands = plots._bandwidths(cells, top)
    bands = bands.withColumns({"start": F.col("lo") - 1, "step": (F.col("hi") - F.col("lo") + 2) / 99})
    terms = plots.kernel_terms(cells.withColumn("times", F.lit(1)), bands, 100)
    return df, terms.count()


def test_kernel_evaluations_fall_with_the_bandwidth(spark):
    _, narrow = kernel_work(spark, 10_000.0)
    _, wide = kernel_work(spark, 0.0)
    assert narrow < 2000 * 10 < wide <= 2000 * 100


@pytest.mark.parametrize("spread", [0.0, 50.0, 10_000.0])
def test_density_equals_all_pairs(spark, spread):
    df, _ = kernel_work(spark, spread)
    got = plots.density(df, "x", "g").orderBy("point").collect()
    band = plots.kde_bandwidth(df, "x", "g").first()
    values = [r["x"] for r in df.collect()]
    weights = [sum(math.exp(-0.5 * ((r["x"] - v) / band["bandwidth"]) ** 2) for v in values) for r in got]
    assert len(got) == 100
    for r, w in zip(got, weights):
        assert r["density"] == pytest.approx(w / sum(weights) if sum(weights) else 0.0, rel=1e-9, abs=1e-300)


# ---- most frequent values by hash

def frequent_cases(spark):
    rng = random.Random(4)
    rows = [(f"id{rng.random()}", rng.choice("abcdefgh") * 50, f"v{int(rng.paretovariate(0.7))}", "z" if i % 3 else f"t{i:05d}", f"pair{i // 2}", None) for i in range(3000)]
    return spark.createDataFrame(rows, "ids string, texts string, tail string, hot string, pairs string, nothing string")


@pytest.mark.parametrize("k", [1, 10, 200])
@pytest.mark.parametrize("ties, smallest", [(10_000, 1_000), (3, 1_000), (0, 5)])
def test_values_counted_by_hash(spark, monkeypatch, k, ties, smallest):
    monkeypatch.setattr(topk, "MOST_TIES", ties)
    monkeypatch.setattr(topk, "SMALLEST", smallest)
    df = frequent_cases(spark)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(topk.top_values(df, df.columns, k, direct_bytes=-1)) == rows(topk.top_values(df, df.columns, k))


def test_unique_values_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(topk, "MOST_TIES", 100)
    df = spark.range(5000).select(F.concat(F.lit("some long text "), F.col("id").cast("string")).alias("t"))
    counted = []
    monkeypatch.setattr(topk, "value_counts", lambda *args: counted.append(args))
    top = topk.top_values(df, ["t"], 5, direct_bytes=0).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [(f"some long text {i}", 1) for i in (0, 1, 10, 100, 1000)]
    # whole values are grouped only after a broadcast semi-join with the few hashes that matter
    assert not counted and "BroadcastHashJoin LeftSemi" in plan(topk.leading_counts(df, ["t"], 5))


# ---- vocabulary by a-priori pruning

def test_pairs_of_rare_words_are_not_counted(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) ** 1.2 for j in range(400)], k=40))) for i in range(300)]
    with_t = text.with_terms(spark.createDataFrame(docs, "id int, text string"), ["w3"]).persist()
    for limit in (5, 60, 10_000, None):
        plain = text._term_counts(text._occurrences(with_t, F.col("terms"))).where((F.col("df") >= 5) & (F.col("df") <= 0.85 * 300))
        plain = plain if limit is None else plain.orderBy(F.desc("cf"), "term").limit(limit)
        rows = lambda d: sorted((r["term"], r["df"], r["cf"]) for r in d.collect())
        assert rows(text.tfidf_terms(with_t, 300, max_features=limit)) == rows(plain)
    singles = text._term_counts(text._occurrences(with_t, F.filter("terms", lambda t: ~t.contains(" "))))
    possible = text.possible_pairs(with_t, singles, 300, 5, 0.85, 60).select("term").distinct().count()
    assert possible < 0.5 * with_t.select(F.explode(F.filter("terms", lambda t: t.contains(" ")))).distinct().count()
    with_t.unpersist()


def test_blocks_of_tokens_count_like_terms(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.choice([0, 1, 2, 40])))) for i in range(200)]
    tokens = text.with_tokens(spark.createDataFrame(docs, "id int, text string"), ["w3"]).persist()
    rows = lambda d: sorted((r["term"], r["df"], r["cf"]) for r in d.collect())
    for block, few in ((1_000_000, 200_000), (50, 200_000), (50, 1)):
        monkeypatch.setattr(text, "BLOCK_TOKENS", block)
        monkeypatch.setattr(text, "BROADCAST_WORDS", few)
        for limit in (30, None):
            assert rows(text.tfidf_terms(tokens, 200, 3, max_features=limit)) == rows(text.tfidf_terms(text.with_pairs(tokens).drop("tokens"), 200, 3, max_features=limit))
    tokens.unpersist()


def test_weights_of_tokens(monkeypatch):
    lists = pa.array([["a", "b", "a", "b"], [], ["x"], ["b", "a", "c"]], pa.list_(pa.string()))
    for block in (1_000_000, 1):
        monkeypatch.setattr(text, "BLOCK_TOKENS", block)
        got = text.weigh(lists, ["a", "a b", "b"], [1.0, 2.0, 3.0]).to_pylist()
        assert [(r["type"], r["size"], r["indices"]) for r in got] == [(0, 3, [0, 1, 2]), (0, 3, []), (0, 3, []), (0, 3, [0, 2])]
        assert got[0]["values"] == pytest.approx(np.array([2.0, 4.0, 6.0]) / 56**0.5) and got[3]["values"] == pytest.approx(np.array([1.0, 3.0]) / 10**0.5)


def test_texts_are_cut_into_tokens_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        read.add(1)
        return value

    docs = spark.range(120).select("id", seen(F.concat(F.lit("river dam w"), (F.col("id") % 7).cast("string"))).alias("text"))
    features = text.tfidf(docs)
    assert features.frame.count() == features.n_docs == 120 and read.value == 120
    features.unpersist()


# ---- cross-validation from moments

@pytest.mark.parametrize("name, params", [("Linear Regression", {}), ("Ridge Regression", {"alpha": 2.0}), ("Ridge Regression", {"alpha": 200.0})])
def test_moments_equal_refits(spark, name, params):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        a, b, c = rng.gauss(0, 1), rng.gauss(1e4, 5), rng.random()
        rows.append((i, [a, b, c], 3 * a - 0.2 * b + rng.gauss(0, 2)))
    train = spark.createDataFrame(rows, "key int, v array<double>, label double").select("key", array_to_vector("v").alias("features"), "label")
    prepared = models.Prepared(type("Names", (), {"names": ["a", "b", "c"]})(), train, train, "label", "key")
    kind = models.MODELS[name]
    fast = models.cv_r2(prepared, name, 4, params).collect()
    slow = models.refit_cv(prepared, kind, 4, {**kind.defaults, **params}).collect()
    assert [(r["fold"], r["n"]) for r in fast] == [(r["fold"], r["n"]) for r in slow]
    for a, b in zip(fast, slow):
        assert a["r2"] == pytest.approx(b["r2"], abs=1e-9)


def test_moments_take_one_pass(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(models, "refit_cv", lambda *args: fits.append(args))
    train = spark.range(50).select(F.col("id").alias("key"), array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"), (F.col("id") * 2.0).alias("label"))
    prepared = models.Prepared(type("Names", (), {"names": ["a", "one"]})(), train, train, "label", "key")
    assert all(r["r2"] == pytest.approx(1.0) for r in models.cv_r2(prepared, "Linear Regression").collect()) and not fits
    assert models.moment_cv(train.limit(0), F.col("key") % 5).count() == 0


# ---- restarts of k-means in one scan

def blobs(spark, sparse):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        middle = [(0, 0, 0), (6, 0, 0), (0, 6, 0), (0, 0, 6)][i % 4]
        point = [m + rng.gauss(0, 1) for m in middle]
        rows.append((i, Vectors.sparse(3, [j for j in range(3) if point[j] > 0], [x for x in point if x > 0]) if sparse or i % 9 == 0 else Vectors.dense(point)))
    return spark.createDataFrame(rows, ["id", "features"]).persist()


@pytest.mark.parametrize("sparse", [True, False])
def test_restarts_together_equal_restarts_alone(spark, sparse):
    frame = blobs(spark, sparse)
    seeds = [1, 2, 3, 4, 5]
    best = kmeans.fit_kmeans(frame, 4, seeds)
    alone = [kmeans.fit_kmeans(frame, 4, [seed]) for seed in seeds]
    assert best.costs == pytest.approx([m.cost for m in alone], rel=1e-9) and best.cost == pytest.approx(min(m.cost for m in alone), rel=1e-9)
    assert best.scans == max(m.scans for m in alone)
    points = np.array([r[0] for r in frame.select(vector_to_array("features")).collect()])
    square = ((points[:, None] - best.centres) ** 2).sum(2)
    assert best.cost == pytest.approx(square.min(1).sum(), rel=1e-9)
    rows = best.transform(frame).orderBy("id").collect()
    assert [r["prediction"] for r in rows] == square.argmin(1).tolist()
    for i in range(4):
        assert best.centres[i] == pytest.approx(points[square.argmin(1) == i].mean(0), abs=1e-3)
    frame.unpersist()


def test_scans_do_not_depend_on_restarts(spark, monkeypatch):
    frame, scans = blobs(spark, True), []
    count = kmeans.sums_by_centre
    monkeypatch.setattr(kmeans, "sums_by_centre", lambda *args: scans.append(1) or count(*args))
    kmeans.fit_kmeans(frame, 3, range(10), iterations=3)
    assert len(scans) <= 4
    frame.unpersist()


def test_runs_at_rest_are_not_scanned_again(spark, monkeypatch):
    frame, runs = blobs(spark, True), []
    count = kmeans.sums_by_centre
    monkeypatch.setattr(kmeans, "sums_by_centre", lambda v, centres: runs.append(len(centres)) or count(v, centres))
    scans = [kmeans.fit_kmeans(frame, 4, [seed]).scans for seed in range(1, 9)]
    runs.clear()
    kmeans.fit_kmeans(frame, 4, range(1, 9))
    assert len(set(scans)) > 1 and runs == [sum(s >= at for s in scans) for at in range(1, max(scans) + 1)]
    frame.unpersist()


def test_clusters_of_few_or_equal_rows(spark):
    same = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0])) for i in range(5)], ["id", "features"])
    model = kmeans.fit_kmeans(same, 3, [1, 2])
    assert model.cost == 0 and {r["prediction"] for r in model.transform(same).collect()} == {0}
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(same.limit(0), 2, [1])


def test_parts_of_the_batch_run_side_by_side(spark, monkeypatch):
    import threading

    from tabulon.operators import text
    from tabulon.plans import batch
    from tabulon.session import scratch_dir
    from tabulon.sources.results import ResultStore

    df, both = spark.range(20), threading.Barrier(2, timeout=60)
    meet = lambda result: lambda *a, **k: both.wait() >= 0 and result
    for name in ("corpus", "tfidf", "assign_clusters", "topic_terms", "topic_distribution", "cluster_profile"):
        monkeypatch.setattr(text, name, lambda *a, **k: df)
    for name in ("fit_topics", "fit_clusters"):
        monkeypatch.setattr(text, name, meet(df))
    assert set(batch.topics(df, "id", ["id"])) == {"topics", "topic_distribution", "cluster_geo_profile"}
    monkeypatch.setattr(batch, "topics", meet({"topics": df, "shares": df.limit(3)}))
    monkeypatch.setattr(batch, "prepare", meet(df))
    for name in ("time_series", "insights", "tag_analysis"):
        monkeypatch.setattr(batch, name, lambda scored: {"all": scored, "few": scored.limit(2)})
    done = batch.run_all(df, "id")
    assert done["prepared"]["table"].count() == 20 and set(done) == {"prepared", *batch.RUN_TYPES}
    store = ResultStore(spark, scratch_dir(spark, "results"))
    assert len(batch.store_all(store, done, scratch_dir(spark, "reports"))) == 4
    kept = {r["run_type"]: {k: v["rows"] for k, v in r["tables"].items()} for r in store.payload("tables map<string, struct<path: string, rows: bigint>>").collect()}
    assert kept == {"nlp": {"topics": 20, "shares": 3}, **{t: {"all": 20, "few": 2} for t in batch.RUN_TYPES if t != "nlp"}}
