"""Multi-layer perceptron regression, trained by mini-batches on the partitions of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

# Layers, epochs, batch size, step, penalty and early stopping of the shipped model.
HIDDEN, EPOCHS, BATCH, STEP, PENALTY, HELD, PATIENCE, LEAST_GAIN = (64, 32), 100, 200, 1e-3, 1e-4, 10, 10, 1e-4
#: Tasks share a batch, so that an epoch has as many steps as with one task; none takes fewer rows than this.
TASK_BATCH = 16

Weights = list[np.ndarray]


def first_weights(sizes: Sequence[int], seed: int) -> Weights:
    """Per layer a matrix and its offsets, uniform within the Glorot bound."""
    rng = np.random.default_rng(seed)
    out = []
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        bound = math.sqrt(6.0 / (fan_in + fan_out))
        out += [rng.uniform(-bound, bound, (fan_in, fan_out)), rng.uniform(-bound, bound, fan_out)]
    return out


def layers(x: np.ndarray, weights: Weights) -> list[np.ndarray]:
    """What each layer passes on, the input first; the last one is linear."""
    out = [x]
    for at in range(0, len(weights), 2):
        z = out[-1] @ weights[at] + weights[at + 1]
        out.append(np.maximum(z, 0.0) if at + 2 < len(weights) else z)
    return out


def gradients(x: np.ndarray, y: np.ndarray, weights: Weights, penalty: float = PENALTY) -> Weights:
    """Of half the mean squared error plus half the penalty, per row, on the squared matrices."""
    passed = layers(x, weights)
    back = (passed[-1][:, 0] - y)[:, None] / len(x)
    out: Weights = []
    for at in range(len(weights) - 2, -1, -2):
        out = [passed[at // 2].T @ back + penalty / len(x) * weights[at], back.sum(0), *out]
        if at:
            back = (back @ weights[at].T) * (passed[at // 2] > 0)
    return out


class Adam:
    """Steps by running means of gradients and of their squares; all weights lie in one vector, of which
    ``weights`` are views, so that a step is a few operations however many layers there are."""

    def __init__(self, weights: Weights, step: float = STEP):
        self.all, self.step, self.done = flat(weights), step, 0
        ends = np.cumsum([w.size for w in weights])
        self.weights = [part.reshape(w.shape) for part, w in zip(np.split(self.all, ends[:-1]), weights)]
        self.mean, self.square, self.spare = np.zeros((3, len(self.all)))

    def follow(self, grads: Weights) -> None:
        self.done += 1
        rate = self.step * math.sqrt(1 - 0.999**self.done) / (1 - 0.9**self.done)
        g, m, v, x = flat(grads), self.mean, self.square, self.spare
        np.subtract(g, m, out=x)
        x *= 0.1
        m += x
        g *= g
        g -= v
        g *= 0.001
        v += g
        np.sqrt(v, out=g)
        g += 1e-8
        np.multiply(m, rate, out=x)
        x /= g
        self.all -= x


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def shaped(values: np.ndarray, sizes: Sequence[int]) -> Weights:
    out, at = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        out.append(values[at : at + fan_in * fan_out].reshape(fan_in, fan_out).copy())
        at += fan_in * fan_out
        out.append(values[at : at + fan_out].copy())
        at += fan_out
    return out


class Perceptron:
    """Predicts by two layers of rectified units; labels are centred and scaled inside."""

    def __init__(self, weights: Weights, mean: float, scale: float, scores: list[float]):
        self.weights, self.mean, self.scale, self.scores = weights, mean, scale, scores

    def transform(self, frame: DataFrame) -> DataFrame:
        weights, mean, scale = self.weights, self.mean, self.scale

        @pandas_udf("double")
        def predicted(v: pd.Series) -> pd.Series:
            x = np.vstack(v.to_list()) if len(v) else np.empty((0, len(weights[0])))
            return pd.Series(layers(x, weights)[-1][:, 0] * scale + mean)

        return frame.withColumn("prediction", predicted(vector_to_array("features")))


def one_epoch(rows: DataFrame, weights: Weights, sizes: Sequence[int], epoch: int, seed: int, tasks: int) -> tuple[Weights, float | None]:
    """Weights after one pass, and the R2 that the present ones reach on the held-out rows.

    Each task follows the mini-batches of its rows, Arrow batch by Arrow batch; what tasks end
    with is merged by its numbers of rows, in lanes of tasks first, so that the driver
    reads one vector a lane.
    """
    lanes, size = max(1, math.isqrt(tasks)), max(TASK_BATCH, BATCH // max(tasks, 1))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, epoch, task])
        mine, sums = Adam(weights), np.zeros(4)
        seen = 0
        for batch in batches:
            if not len(batch):
                continue
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            held = batch["held"].to_numpy(zero_copy_only=False)
            x, y = v[held, :-1], v[held, -1]
            if len(y):
                error = layers(x, weights)[-1][:, 0] - y
                sums += [len(y), error @ error, y.sum(), y @ y]
            x, y = v[~held, :-1], v[~held, -1]
            order = rng.permutation(len(y))
            for at in range(0, len(y), size):
                some = order[at : at + size]
                mine.follow(gradients(x[some], y[some], mine.weights))
            seen += len(y)
        found = np.concatenate([[seen], sums, mine.all * seen])
        yield pa.RecordBatch.from_pydict({"task": [task], "lane": [task % lanes], "x": [found.tobytes()]}, pa.schema({"task": pa.int32(), "lane": pa.int32(), "x": pa.binary()}))

    def add_up(lane: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in lane.sort_by("task")["x"].to_pylist())
        return pa.table({"lane": lane["lane"].slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

    ended = rows.mapInArrow(train, "task int, lane int, x binary").groupBy("lane").applyInArrow(add_up, "lane int, x binary")
    total = sum(np.frombuffer(bytes(r["x"])) for r in sorted(ended.collect(), key=lambda r: r["lane"]))
    seen, held, error, y, yy = total[:5]
    spread = yy - y * y / held if held else 0.0
    return shaped(total[5:] / seen, sizes) if seen else weights, 1 - error / spread if spread > 0 else None


def fit_perceptron(train: DataFrame, hidden: Sequence[int] = HIDDEN, epochs: int = EPOCHS, seed: int = 42, key: Column | None = None) -> Perceptron:
    """Learn ``label`` from ``features`` (dense or sparse vectors of one length, scaled).

    A tenth of the rows, by hash of ``key`` (by default the column ``key``), is held out; training
    ends when their R2 has not risen by 0.0001 for ten epochs, and the best weights stay. One
    job an epoch; the result depends on the partitions and their order, which ``prepare``
    takes from the data alone. Without held-out rows all epochs run. An empty table raises.
    """
    facts = train.agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("scale")).first()
    first = train.select("features").first()
    if first is None:
        raise ValueError("no rows to learn from")
    sizes = [first["features"].size, *hidden, 1]
    mean, scale = facts["mean"], facts["scale"] or 1.0
    place = F.pmod(F.xxhash64(F.col("key") if key is None else key, F.lit(seed), F.lit("held")), F.lit(HELD))
    rows = train.select(F.array_append(vector_to_array("features"), (F.col("label") - mean) / scale).alias("v"), (place == 0).alias("held"))
    tasks = rows.rdd.getNumPartitions()
    weights = first_weights(sizes, seed)
    best, best_score, since, scores = weights, -math.inf, 0, []
    for epoch in range(epochs + 1):
        after, score = one_epoch(rows, weights, sizes, epoch, seed, tasks)
        scores.append(score)
        # without held-out rows the last weights stay
        gained = score is None or score > best_score + LEAST_GAIN
        since = 0 if gained else since + 1
        if score is None or score > best_score:
            best, best_score = weights, score if score is not None else best_score
        if since >= PATIENCE:
            break
        weights = after
    return Perceptron(best, mean, scale, scores)
