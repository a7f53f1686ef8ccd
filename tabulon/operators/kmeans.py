"""k-means with all restarts in one scan per iteration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

#: Rows that the first centres are drawn from; every row takes part in the iterations.
SAMPLE_ROWS = 2_000
#: Cells of one dense block of rows.
BLOCK_CELLS = 2_000_000
ITERATIONS, TOLERANCE = 20, 1e-4


def dense_blocks(indices: pa.Array, values: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Vectors as dense blocks of bounded size; the indices of a dense vector are null."""
    cells = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype("int64")
    ends = np.concatenate([[0], np.cumsum(cells)])
    flat = values.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(flat)) - np.repeat(ends[:-1], cells)
    sparse = indices.is_valid().to_numpy(zero_copy_only=False)
    place[np.repeat(sparse, cells)] = indices.flatten().to_numpy(zero_copy_only=False)
    step = max(1, BLOCK_CELLS // width)
    for at in range(0, len(cells), step):
        n = cells[at : at + step]
        block = np.zeros((len(n), width))
        mine = slice(ends[at], ends[at + len(n)])
        block[np.repeat(np.arange(len(n)), n), place[mine]] = flat[mine]
        yield block


LISTS = pa.list_(pa.int32()), pa.list_(pa.float64())


def distances(block: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to the centres, ``(rows, restarts, k)``."""
    restarts, k, width = centres.shape
    flat = centres.reshape(-1, width)
    square = (block * block).sum(1)[:, None] - 2 * block @ flat.T + (flat * flat).sum(1)
    return np.maximum(square, 0).reshape(-1, restarts, k)


@dataclass
class Centres:
    """The best of several restarts: ``centres`` (k, width), its ``cost``, and the costs of all."""

    centres: np.ndarray
    cost: float
    costs: list[float]
    scans: int

    def transform(self, frame: DataFrame) -> DataFrame:
        """Add ``prediction``, the number of the nearest centre; of equally near ones the first."""
        return frame.withColumn("prediction", _nearest(F.unwrap_udt("features"), self.centres))


def _nearest(vectors: Column, centres: np.ndarray) -> Column:
    @pandas_udf("int")
    def nearest(v: pd.DataFrame) -> pd.Series:
        blocks = dense_blocks(pa.array(v["indices"], LISTS[0]), pa.array(v["values"], LISTS[1]), centres.shape[1])
        return pd.Series(np.concatenate([np.empty(0, "int32"), *[distances(b, centres[None])[:, 0].argmin(1) for b in blocks]]).astype("int32"))

    return nearest(vectors)


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < k:
        near = distances(sample, np.array(chosen)[None])[:, 0].min(1)
        total = near.sum()
        chosen.append(sample[rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))])
    return np.array(chosen)


def sums_by_centre(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan: sum and number of the rows nearest to each centre of each restart, and the
    cost of each restart. Tasks add up matrix products; equal cells are added on Spark."""
    restarts, k, width = centres.shape
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((restarts * k, width + 2))
        for batch in batches:
            for block in dense_blocks(batch["indices"], batch["values"], width):
                square = distances(block, sent.value)
                near = square.argmin(2)
                mine = (near[:, :, None] == np.arange(k)).reshape(len(block), -1).astype("float64")
                total[:, :width] += mine.T @ block
                total[:, width] += mine.sum(0)
                total[::k, width + 1] += square.min(2).sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["at", "x"])

    total = np.zeros(restarts * k * (width + 2))
    for row in vectors.mapInArrow(add_up, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[row["at"]] = row["x"]
    sent.unpersist()
    total = total.reshape(restarts, k, width + 2)
    return total[:, :, :width], total[:, :, width], total[:, 0, width + 1]


def fit_kmeans(frame: DataFrame, k: int, seeds: Sequence[int], iterations: int = ITERATIONS) -> Centres:
    """Best of one run per seed over the vectors ``features``.

    The centres of all runs are moved together: an iteration is one scan, however many
    runs there are. A run whose centres have come to rest stays as it is and is not compared again; a centre
    without rows stays where it is. First centres come from a bounded sample by hash.
    """
    vectors = frame.select(F.unwrap_udt("features").alias("v")).select("v.size", "v.indices", "v.values")
    order = F.xxhash64("size", "indices", "values")
    rows = vectors.orderBy(order).limit(SAMPLE_ROWS).collect()
    if not rows:
        raise ValueError("no rows to cluster")
    width = rows[0]["size"] if rows[0]["size"] is not None else len(rows[0]["values"])
    sample = np.concatenate(list(dense_blocks(pa.array([r["indices"] for r in rows], LISTS[0]), pa.array([r["values"] for r in rows], LISTS[1]), width)))
    centres = np.array([first_centres(sample, k, seed) for seed in seeds])
    moving, costs = np.arange(len(centres)), np.zeros(len(centres))
    for scan in range(iterations + 1):
        now = centres[moving]
        sums, counts, costs[moving] = sums_by_centre(vectors, now)
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], now)
        resting = ((moved - now) ** 2).sum(2).max(1) <= TOLERANCE**2
        if scan == iterations or resting.all():
            break
        moving = moving[~resting]
        centres[moving] = moved[~resting]
    best = int(np.argmin(costs))
    return Centres(centres[best], float(costs[best]), costs.tolist(), scan + 1)
