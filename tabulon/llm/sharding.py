"""Uniform shuffle into shards of exact size by a drawn communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import bits_for, row_hash, running, top_bits

#: Most source blocks, and so the most rows of the communication matrix on the driver.
MAX_BLOCK_BITS = 12


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls, drawn without replacement, are good.

    Inversion outwards from the mode: about one step per standard deviation,
    whatever the size of the numbers.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    g = math.lgamma

    def chosen(n: int, k: int) -> float:
        return g(n + 1) - g(k + 1) - g(n - k + 1)

    peak = math.exp(chosen(good, mode) + chosen(bad, draws - mode) - chosen(good + bad, draws))
    u = rng.random() - peak
    down, up, p_down, p_up = mode, mode, peak, peak
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up + p_down < 1e-300:
            break
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, distributed as in a uniform shuffle.

    Row sums are ``block_rows`` and column sums ``shard_rows``, exactly.
    """
    rng = random.Random(seed)
    left = list(shard_rows)
    matrix = []
    for rows in block_rows:
        line, pool = [], sum(left)
        for shard, room in enumerate(left):
            taken = hypergeometric(rng, room, pool - room, rows)
            pool -= room
            rows -= taken
            left[shard] -= taken
            line.append(taken)
        matrix.append(line)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Row counts of shards differ by one at most. Rows fall into hashed blocks; the
    driver draws the block x shard matrix (at most 4,096 blocks) from the exact
    block counts; each block is permuted and cut by its line of the matrix; after
    the exchange each shard is permuted again, in hash buckets that grow in
    number with the rows. All columns decide a row's place, so reruns agree;
    identical rows, nulls included, are interchangeable. An empty table stays
    empty. Input columns named ``shard`` or ``slot`` are replaced.
    """
    spark, rows = df.sparkSession, df.count()
    hashed = df.withColumn("__hash", row_hash(df, seed)).drop("shard", "slot")
    bits = bits_for(rows, most=MAX_BLOCK_BITS)
    hashed = hashed.withColumn("__block", top_bits(F.col("__hash"), bits))
    counts = sorted((r["__block"], r["count"]) for r in hashed.groupBy("__block").count().collect())
    even = [rows // shards + (k < rows % shards) for k in range(shards)]
    matrix = communication_matrix([n for _, n in counts], even, seed)
    bounds = [(block, [sum(line[: k + 1]) for k in range(shards)]) for (block, _), line in zip(counts, matrix)]
    drawn = spark.createDataFrame(bounds, "__block long, __bounds array<long>")
    placed = running(hashed, ["__block"], F.lit(0), ["__hash"], F.lit(1).cast("long"), "__rank")
    placed = placed.join(F.broadcast(drawn), "__block").withColumn("shard", F.size(F.filter("__bounds", lambda x: x < F.col("__rank"))))
    again = placed.withColumn("__again", F.xxhash64(F.lit(seed + 1), "__hash", "__rank"))
    inside = bits_for(rows // shards + 1)
    slotted = running(again, ["shard"], top_bits(F.col("__again"), inside), ["__again", "__hash", "__rank"], F.lit(1).cast("long"), "__slot")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return slotted.select(*[f"`{c}`" for c in kept], "shard", (F.col("__slot") - 1).alias("slot"))
