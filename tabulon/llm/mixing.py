"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import WORD, bits_for, row_hash, running, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Share ``budget`` by weight; no source gets more than ``most`` times its size,
    and what exceeds that is shared again among the others."""
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda k: (caps[k] / weights[k], k))
    level, capped, weight = 0.0, 0.0, sum(weights)
    out = list(caps)
    for i, k in enumerate(order):
        level = (budget - capped) / weight
        if level * weights[k] <= caps[k]:
            for j in order[i:]:
                out[j] = level * weights[j]
            break
        capped += caps[k]
        weight -= weights[k]
    return out


def shuffle_key(doc_id: Column, epoch: Column) -> Column:
    """60 bits of a digest: the shuffled order of documents, anew in every epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", epoch.cast("string"), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def mixed(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per distinct input row: ``__row`` (its hash), ``id``, ``size``, ``source_size``,
    ``target``, ``copies`` (how often the mix takes it), ``finishes`` (the virtual finish
    times of the taken copies) and ``rows`` (how many identical rows it stands for).

    Sources by code point, null last, have the weights in turn; they are dimension
    rows, and only their sums and targets pass through the driver. Each epoch
    offers every document of a source once, in shuffled order. A copy's virtual
    finish time is the running size of its source over the source's target; the
    mix is the longest prefix in order of that time within the budget. Identical
    rows are taken together. Rows without words are never taken.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), row_hash(df).alias("__row"))
    units = written(narrow.groupBy("id", "source", "size", "__row").agg(F.count("*").alias("rows")), "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("s"), F.sum("rows").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    budget = share * sum(r["s"] for r in sums)
    goals = targets([r["s"] for r in sums], [weights[k % len(weights)] for k in range(len(sums))], budget, float(epochs)) if sums else []
    plan = spark.createDataFrame([(k, r["source"], r["s"], t) for k, (r, t) in enumerate(zip(sums, goals))], "src int, name string, source_size long, target double")
    joined = units.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name")))
    bits = bits_for(max((r["n"] for r in sums), default=0))
    offered = joined.where("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).withColumn("__key", shuffle_key(F.col("id"), F.col("epoch")))
    whole = F.col("size") * F.col("rows")
    queue = running(offered, ["src", "epoch"], F.shiftright("__key", 60 - bits), ["__key", "__row"], whole, "__total")
    queue = queue.withColumn("finish", (F.col("__total") + F.col("epoch") * F.col("source_size")).cast("double") / F.col("target"))
    per_unit = 1 << bits_for(sum(r["n"] for r in sums) * epochs)
    # as many buckets for finish times up to 1 as for each doubling beyond
    spread = F.floor(F.when(F.col("finish") <= 1, F.col("finish")).otherwise(1 + F.log2("finish")) * per_unit).cast("long")
    line = running(queue, [], spread, ["finish", "src", "epoch", "__key", "__row"], whole, "__filled") if sums else queue.withColumn("__filled", F.lit(0).cast("long"))
    taken = line.where(F.col("__filled") <= F.lit(budget)).groupBy("__row", "id").agg(F.count("*").alias("copies"), F.sort_array(F.collect_list("finish")).alias("finishes"))
    back = joined.join(taken.withColumnRenamed("id", "__id").withColumnRenamed("__row", "__taken"), (F.col("__row") == F.col("__taken")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    return back.select("__row", "id", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), "finishes", "rows")


def mix(df: DataFrame, size: Column, **options) -> DataFrame:
    """The mixed rows with their input columns, a row for every copy, range-sorted by virtual finish time."""
    plan = mixed(df, size, **options).where("copies > 0").select(F.col("__row").alias("__unit"), F.col("finishes").alias("__finishes"))
    tagged = df.withColumn("__row", row_hash(df))
    copies = tagged.join(plan, F.col("__row") == F.col("__unit")).withColumn("__finish", F.explode("__finishes"))
    return copies.orderBy("__finish", "__row").select(*[tagged[f"`{c}`"] for c in df.columns])


#: The same mix in SQL; DuckDB's digests and window sums stand in for the hashed buckets.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(2 * s AS DOUBLE) AS cap,
    CAST(1.5 * (SELECT sum(s) FROM sums) AS DOUBLE) AS budget FROM sums
), filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed
), level AS (
  SELECT first((budget - capped) / rest ORDER BY cap / w, k) AS l FROM filled WHERE (budget - capped) / rest * w <= cap
), goals AS (
  SELECT f.source, k, CAST(s AS BIGINT) AS source_size, least(cap, l * w) AS target, budget FROM filled f LEFT JOIN level ON true
), offered AS (
  SELECT doc_id, size, k, epoch, source_size, target, budget,
    CAST('0x' || substr(md5(CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS o
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source, (VALUES (0), (1)) e(epoch) WHERE size > 0
), queue AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY k, epoch ORDER BY o ROWS UNBOUNDED PRECEDING) + epoch * source_size AS DOUBLE) / target AS finish FROM offered
), line AS (
  SELECT *, sum(size) OVER (ORDER BY finish, k, epoch, o ROWS UNBOUNDED PRECEDING) AS total FROM queue
), taken AS (SELECT doc_id, count(*) AS copies FROM line WHERE total <= budget GROUP BY doc_id)
SELECT d.doc_id, d.size, g.source_size, round(g.target, 6) AS target, CAST(d.size * coalesce(t.copies, 0) AS BIGINT) AS taken
FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN taken t ON t.doc_id = d.doc_id
"""
