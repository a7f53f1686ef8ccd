"""The registered queries of this package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm import classifier, embeddings, lm, merkle, mixing, overlap, packing, phrases, quality, sharding, tokens, toxicity, warc
from tabulon.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op1_quality_rules", quality.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Line-first quality rules over all documents."""
    judged = quality.clean_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_kept_lines")


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(narrow, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mixing", mixing.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing.mixed(table(spark, folder, "documents"), mixing.word_count(F.col("text")))
    rows = plan.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_embedding_near_dedup", embeddings.SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings, whatever their labels."""
    return embeddings.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding")).drop("embedding")


@query("op4_ngram_jaccard_join", overlap.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of word shingles overlap."""
    return overlap.similar_documents(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op5_warc", warc.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to ZIP-packaged web archives and read back."""
    return warc.round_trip(spark, table(spark, folder, "pages")).drop("url")


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole document."""
    return tokens.count_tokens(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2,048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole document, learnt from labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"), toxicity.toxic_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_lm_scoring")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Masked pseudo-likelihood of every whole document under a network of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lm.score_documents(docs, lm.fit(docs)).drop("text")


@query("op11_quality_classifier")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole document, learnt from labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", (classifier.remainder(F.col("doc_id")) == 2).alias("held_out"), classifier.class_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, roots and checked proofs of all documents, a third of them tampered with."""
    docs = table(spark, folder, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(touched, merkle.lower_cased(F.col("text"))).otherwise(F.col("text"))
    return merkle.prove(docs, {"text": text}).withColumnRenamed("id", "doc_id")


@query("op13_phrase_collocations", phrases.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two to five words of each language over all documents."""
    return phrases.collocations(table(spark, folder, "documents"))
