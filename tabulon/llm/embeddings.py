"""Embedding near-duplicates by randomised-rotation binary codes.

Each vector gets one sign bit per rotated coordinate and a correction factor, the
inner product of the vector with its own code. The pair (code, factor) estimates
the inner product with any other vector without bias, with a known spread; only
pairs whose confidence interval reaches the threshold are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import components, written

THRESHOLD = 0.95
#: Fewest nearest pivots whose cells a vector enters; two vectors are compared in the first cell that they share.
CELLS = 3
#: Vectors that a cell is meant to hold, and most pivots.
CELL_ROWS, MAX_PIVOTS = 1000, 32_768
#: Pivots come from at most so many vectors, chosen by hash.
MAX_SAMPLE = 65_536
#: Rows of one block of a cell; larger cells are compared block by block.
BLOCK_ROWS = 2048
#: Half-width of the confidence interval in standard deviations.
CONFIDENCE = 4.0


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in squares
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, and their correction factors."""
    turned = units @ rotation(units.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(units.shape[1])


def estimate(units: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products of ``units`` (rows) with the coded
    vectors (columns), and the half-width of their confidence interval by column."""
    dim = units.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype("float32") * 2 - 1
    turned = (units @ rotation(dim)).astype("float32")
    guess = (turned @ signs.T) / (np.sqrt(dim) * factors).astype("float32")
    spread = np.sqrt(np.maximum(0, 1 - factors**2) / factors**2 / max(1, dim - 1))
    return guess, CONFIDENCE * spread + 1e-5


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Sample vectors in order, but those close to a pivot already chosen."""
    chosen = np.empty((min(wanted, len(sample)), sample.shape[1]))
    n = 0
    for vector in sample:
        if n == len(chosen):
            break
        if n == 0 or (chosen[:n] @ vector).max() < 0.8:
            chosen[n] = vector
            n += 1
    return chosen[:n]


def cells_among(pivots: int) -> int:
    """Cells that a vector enters: more as pivots crowd, or pairs at the threshold would
    meet in none of them (3 cells among 32,768 pivots lose a tenth of such pairs)."""
    return max(CELLS, int(pivots).bit_length())


def pivots_for(rows: int) -> int:
    wanted = 8
    for _ in range(3):  # cells rise with pivots, pivots with cells
        wanted = int(min(MAX_PIVOTS, max(8, rows * cells_among(wanted) / CELL_ROWS)))
    return wanted


def nearest_cells(units: np.ndarray, points: np.ndarray | None) -> np.ndarray:
    """The nearest pivots of each vector; one cell for all if pivots are few."""
    if points is None or len(points) <= (cells := cells_among(len(points))):
        return np.zeros((len(units), 1), "int64")
    return np.concatenate([np.argpartition(-(units[k : k + 4096] @ points.T), cells - 1, axis=1)[:, :cells] for k in range(0, len(units), 4096)])


def fit_pivots(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, from a bounded sample by hash."""
    sample = vectors.orderBy(F.xxhash64(F.lit(3), "node")).limit(min(MAX_SAMPLE, 16 * MAX_PIVOTS)).select("vector").toPandas()["vector"]
    wanted = pivots_for(rows)
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    return {dim: choose_pivots(unit(np.array(vs, "float64")), wanted) for dim, vs in by_dim.items()}


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes under the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def compare(group: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links of one block, or between two blocks, of a cell: for each vector the number
    of linked vectors (copies counted) and the smallest node linked to it here."""
    group = group.sort_values(["chunk", "node"], ignore_index=True)
    cell, left, right = int(group["cell"].iat[0]), int(group["left"].iat[0]), int(group["right"].iat[0])
    nodes, copies = group["node"].to_numpy("int64"), group["copies"].to_numpy("int64")
    units = unit(np.stack(group["vector"].to_numpy()).astype("float64"))
    codes = np.stack([np.frombuffer(c, "uint8") for c in group["code"]])
    factors, entered = group["factor"].to_numpy("float64"), np.stack(group["cells"].to_numpy())
    first = int((group["chunk"] == left).sum())
    columns = slice(0, len(nodes)) if left == right else slice(first, len(nodes))
    links, pairs_a, pairs_b = np.zeros(len(nodes), "int64"), [], []
    for at in range(0, first, 512):
        rows = slice(at, min(at + 512, first))
        guess, half = estimate(units[rows], codes[columns], factors[columns])
        i, j = np.nonzero(guess >= threshold - half)
        i, j = i + at, j + columns.start
        if left == right:
            i, j = i[i < j], j[i < j]
        step = max(1, 2_000_000 // entered.shape[1] ** 2)
        for part in range(0, len(i), step):
            p, q = i[part : part + step], j[part : part + step]
            near = np.einsum("ij,ij->i", units[p], units[q]) >= threshold
            p, q = p[near], q[near]
            shared = np.where(entered[p][:, :, None] == entered[q][:, None, :], entered[p][:, :, None], np.iinfo("int64").max).min((1, 2))
            p, q = p[shared == cell], q[shared == cell]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            pairs_a.append(p)
            pairs_b.append(q)
    root = roots(len(nodes), np.concatenate(pairs_a or [[]]).astype("int64"), np.concatenate(pairs_b or [[]]).astype("int64"))
    found = links > 0
    return pd.DataFrame({"node": nodes[found], "links": links[found], "root": nodes[root][found]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``n_links`` (long), ``component_id`` (smallest id reachable) and ``kept``.

    Vectors that are null, zero, empty or hold null or non-finite components link
    with nothing; vectors link only with vectors of their length. Equal vectors
    are one node with a number of copies, so groups of copies are never paired
    off. Nodes enter the cells of their nearest pivots; blocks of cells are
    compared in tasks of bounded size, which return counts and a spanning forest.
    Pivots are fitted on a bounded sample, all vectors are indexed, and no link
    below the threshold is returned. A pair that shares no cell is not seen: the
    number of cells rises with the pivots so that this is rare (recall in README). Null ids never name a component; a component
    without any id is null, and its rows are not kept. Same-named input columns
    are replaced.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    kept = [f"`{c}`" for c in df.columns if c.lower() not in ("n_links", "component_id", "kept")]
    tagged = df.select(*kept, F.when(usable, F.xxhash64(F.transform(vector, lambda x: x + 0.0))).alias("__node"))
    valid = tagged.where("__node IS NOT NULL").select(F.col("__node").alias("node"), F.col(f"`{id_col}`").alias("id"), F.transform(vector, lambda x: x + 0.0).alias("vector"))
    reps = written(valid.groupBy("node", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least")), "vectors")
    n = reps.count()
    pivots = fit_pivots(reps, n) if n else {}

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                units = unit(np.stack(part["vector"].to_numpy()).astype("float64"))
                codes, factors = encode(units)
                near = np.sort(nearest_cells(units, pivots.get(dim)).astype("int64") + (dim << 32), axis=1)
                yield part.assign(code=[c.tobytes() for c in codes], factor=factors, cells=list(near))[["node", "vector", "copies", "code", "factor", "cells"]]

    coded = reps.select("node", "vector", "copies").mapInPandas(enter, "node long, vector array<double>, copies long, code binary, factor double, cells array<long>")
    entered = written(coded.withColumn("cell", F.explode("cells")), "cells")
    chunks = entered.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("chunks"))
    placed = entered.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64(F.lit(4), "node"), F.col("chunks").cast("long")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")})

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        return compare(group, threshold)

    found = written(sent.drop("chunks", "other").groupBy("cell", "left", "right").applyInPandas(compared, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = reps.select("node", "copies", "least").join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("name"))
    known = named.join(names, "root").select(F.col("node").alias("__n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("name"))
    out = tagged.join(known, F.col("__node") == F.col("__n"), "left")
    component = F.when(F.col("__node").isNull(), F.col(f"`{id_col}`")).otherwise(F.col("name"))
    out = out.select(*kept, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(False)))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
