"""Bounds of what one task of the n-gram join holds, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import overlap
from tests.llm.cases import documents


def test_parts_are_bounded_by_shingles(spark):
    rows = [(k, 50_000 if k % 3 else 10, 1 if k < 900 else 2) for k in range(1000)]
    sized = spark.createDataFrame(rows, "key long, n long, block long")
    parts = overlap.in_parts(sized).groupBy("block", "part").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    assert sum(r["docs"] for r in parts) == 1000 and len(parts) > 2
    assert max(r["n"] for r in parts) <= overlap.BLOCK_SHINGLES + 50_000
    few = overlap.in_parts(spark.range(10_000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("block")))
    assert few.groupBy("part").count().agg(F.max("count")).first()[0] <= overlap.BLOCK_DOCS


def test_small_parts_find_the_same(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[: 190 + k % 10], f"x{k}"])) for k in range(40)] + [(100 + k, f"lone text number {k} of its own") for k in range(5)]
    found = lambda: sorted(tuple(r) for r in overlap.similar_documents(documents(spark, rows)).collect())
    whole = found()
    monkeypatch.setattr(overlap, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(overlap, "BLOCK_DOCS", 4)
    monkeypatch.setattr(overlap, "SALTS", 2)
    assert found() == whole and len({r[3] for r in whole}) == 6


def test_shared_lists(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK_DOCS", 3)
    monkeypatch.setattr(overlap, "SALTS", 2)
    posted = [(1, k) for k in range(20)] + [(2, 5), (2, 6), (2, 6), (3, 7), (3, 7)]
    got = sorted(map(tuple, overlap.shared_lists(spark.createDataFrame(posted, "token long, key long")).collect()))
    assert got == [(1, k, 20) for k in range(20)] + [(2, 5, 3), (2, 6, 3)]


def test_texts_are_hashed_once(spark):
    texts = ["a B c d e f", "A b C d e f", "one two", "", None, "x" * 500]
    docs = documents(spark, list(enumerate(texts))).coalesce(1)
    rows = {r["id"]: r for r in overlap.document_sets(docs, "doc_id", "text", 4, 85, np.empty(0, "int64")).collect()}
    # equal sets of a task post once, sets without shingles never
    assert [rows[k]["n"] for k in range(6)] == [3, 3, 1, 0, 0, 1] and rows[0]["key"] == rows[1]["key"]
    assert rows[0]["posted"] and not any(rows[k]["posted"] for k in (1, 3, 4))
    assert set(rows[0]["posted"]) <= set(overlap.shingles(texts[1]).tolist()) and rows[2]["posted"] == overlap.shingles(b"one two").tolist()
    overlap.shingles(texts[5])
    assert max(map(len, overlap.HASHES)) <= overlap.KEPT_BYTES  # one long word is not kept
