"""The perceptron: gradients, learning, early stopping, partitions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulon.operators import perceptron
from tabulon.operators.models import Voting, _voting, regression_metrics
from tabulon.session import spread


def curved(spark, rows=4000, parts=4):
    """A label that no linear model explains, on a large scale."""
    u = lambda n: (F.pmod(F.xxhash64("key", F.lit(n)), F.lit(2001)) / 1000.0 - 1.0).cast("double")
    df = spark.range(rows).withColumnRenamed("id", "key").withColumns({"a": u(1), "b": u(2)})
    df = df.withColumn("label", F.abs("a") * 3e6 + F.col("b") * F.col("b") * 2e6 + 5e7)
    return spread(df.select("key", "label", array_to_vector(F.array("a", "b")).alias("features")), "key", rows * parts).persist()


def loss(x, y, weights, penalty):
    error = perceptron.layers(x, weights)[-1][:, 0] - y
    return (error @ error + penalty * sum((w**2).sum() for w in weights[::2])) / 2 / len(x)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    weights = perceptron.first_weights([3, 5, 4, 1], 2)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    grads = perceptron.gradients(x, y, weights, 0.1)
    for w, g in zip(weights, grads):
        for at in np.ndindex(w.shape):
            held, w[at] = w[at], w[at] + 1e-6
            up = loss(x, y, weights, 0.1)
            w[at] = held - 1e-6
            down = loss(x, y, weights, 0.1)
            w[at] = held
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_weights_come_back_from_one_vector():
    weights = perceptron.first_weights([3, 5, 4, 1], 2)
    again = perceptron.shaped(perceptron.flat(weights), [3, 5, 4, 1])
    assert all((a == b).all() for a, b in zip(weights, again, strict=True))


def test_learns_what_a_line_cannot(spark):
    rows = curved(spark)
    model = perceptron.fit_perceptron(rows, epochs=40)
    scored = model.transform(rows)
    assert scored.columns == [*rows.columns, "prediction"]
    assert regression_metrics(scored).first()["r2"] > 0.9
    assert max(model.scores) > 0.9
    again = perceptron.fit_perceptron(rows, epochs=2)
    assert again.scores == perceptron.fit_perceptron(rows, epochs=2).scores
    rows.unpersist()


def test_stops_early_and_keeps_the_best(spark, monkeypatch):
    rows = curved(spark, 400, 1)
    given = iter([0.1, 0.5, *[0.5] * 50])
    marks = iter(range(1, 60))
    monkeypatch.setattr(perceptron, "one_epoch", lambda *a: ([np.full(1, float(next(marks)))], next(given)))
    model = perceptron.fit_perceptron(rows, epochs=100)
    assert len(model.scores) == 2 + perceptron.PATIENCE
    assert model.weights[0][0] == 1.0  # those that scored 0.5 first
    rows.unpersist()


def test_constant_label_and_empty_table(spark):
    rows = curved(spark, 100, 1).withColumn("label", F.lit(7.0))
    model = perceptron.fit_perceptron(rows, epochs=1)
    assert all(abs(r["prediction"] - 7) < 2 for r in model.transform(rows).collect())
    with pytest.raises(ValueError, match="no rows"):
        perceptron.fit_perceptron(rows.limit(0))


def test_voting_has_the_three_members(spark):
    rows = curved(spark, 600, 1)
    model = _voting({"n_estimators": 3}, rows)
    assert isinstance(model, Voting) and isinstance(model.members[2], perceptron.Perceptron)
    alone = [m.transform(rows).orderBy("key").select("prediction").toPandas()["prediction"] for m in model.members]
    both = model.transform(rows).orderBy("key").select("prediction").toPandas()["prediction"]
    assert np.allclose(both, sum(alone) / 3)
    rows.unpersist()


def test_a_step_is_one_pass_over_all_weights():
    weights = perceptron.first_weights([3, 5, 4, 1], 1)
    at_once, start = perceptron.Adam(weights), [w.copy() for w in weights]
    rng = np.random.default_rng(2)
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    plain = [w.copy() for w in weights]
    for done in range(1, 6):
        grads = [rng.normal(size=w.shape) for w in weights]
        at_once.follow([g.copy() for g in grads])
        rate = perceptron.STEP * (1 - 0.999**done) ** 0.5 / (1 - 0.9**done)
        for w, g, m, v in zip(plain, grads, mean, square):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * m / (np.sqrt(v) + 1e-8)
    # views of one vector; the weights that were given stay as they are
    assert all(np.shares_memory(w, at_once.all) for w in at_once.weights) and all((a == b).all() for a, b in zip(weights, start))
    assert all((a == b).all() for a, b in zip(at_once.weights, plain))
