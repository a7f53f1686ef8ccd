"""Text topics: normalising, TF-IDF, topic model, clusters and their profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tabulon.operators.kmeans import fit_kmeans
from tabulon.operators.topk import top_per_group
from tabulon.schema import present, ref, require
from tabulon.session import checkpointed, spread

MIN_DOCS = 50


def normalized_text(columns: Sequence[str]) -> Column:
    """Columns joined by a space, lower-case, only a-z, 0-9 and whitespace kept."""
    joined = F.concat_ws(" ", *[F.coalesce(ref(c).cast("string"), F.lit("")) for c in columns])
    return F.regexp_replace(F.lower(joined), r"(?U)[^a-z0-9\s]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def corpus(df: DataFrame, key: str, columns: Sequence[str], low: int = 5, high: int = 500, keep: Sequence[str] = ()) -> DataFrame:
    """``(key, kept columns, text, n_tokens)`` of documents with a usable number of tokens."""
    columns = present(df, columns)
    require(df, key, *keep)
    if not columns:
        raise ValueError("no text column")
    # The one-element explode keeps the filter on the text from being moved below
    # it, where the text would be normalised a second time.
    docs = df.select(ref(key), *[ref(c) for c in keep], F.explode(F.array(normalized_text(columns))).alias("text"))
    return docs.withColumn("n_tokens", F.size(words(F.col("text")))).where(F.col("n_tokens").between(low, high))


def english_stop_words() -> list[str]:
    """Spark's English list, without apostrophes as in normalised text."""
    return sorted({w.replace("'", "") for w in StopWordsRemover.loadDefaultStopWords("english")})


def with_tokens(docs: DataFrame, stop_words: Sequence[str], text: str = "text") -> DataFrame:
    """Add ``tokens``: words of two or more characters without stop words."""
    return docs.withColumn("tokens", F.filter(words(F.col(text)), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words))))


def with_terms(docs: DataFrame, stop_words: Sequence[str], text: str = "text") -> DataFrame:
    """Add ``terms``: words of two or more characters without stop words, and
    the pairs of neighbours among them."""
    return with_pairs(with_tokens(docs, stop_words, text)).drop("tokens")


def with_pairs(docs: DataFrame) -> DataFrame:
    """Add ``terms``, the ``tokens`` followed by the pairs of neighbours among them."""
    left = F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0)))
    right = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    pairs = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
    return docs.withColumn("terms", F.concat("tokens", pairs))


def _occurrences(docs: DataFrame, terms: Column) -> DataFrame:
    """``(d, term)``: every occurrence of an array column with 0, and with 1 each distinct
    term of a row. Documents are made distinct per row, before any shuffle."""
    occurrence = F.array(F.struct(F.lit(0).alias("d"), terms.alias("t")), F.struct(F.lit(1).alias("d"), F.array_distinct(terms).alias("t")))
    return docs.select(F.inline(occurrence)).select("d", F.explode("t").alias("term"))


def _term_counts(occurrences: DataFrame) -> DataFrame:
    """``(term, df, cf)``; the aggregate combines in the map tasks."""
    return occurrences.groupBy("term").agg(F.sum("d").alias("df"), F.sum(1 - F.col("d")).alias("cf"))


#: Words that may stand in a counted pair are broadcast up to this number.
BROADCAST_WORDS = 200_000


def possible_pairs(docs: DataFrame, words: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """Occurrences ``(d, term)`` of the pairs that may still get into the vocabulary.

    A pair occurs no more often, and in no more documents, than either of its words.
    Where ``max_features`` words pass the limits already, the count of the last of
    these is a floor for pairs as well.
    """
    least = least_count(words, n_docs, min_df, max_df, max_features)
    able = words.where((F.col("df") >= min_df) & (F.col("cf") >= least)).select("term")
    able = F.broadcast(able) if able.count() <= BROADCAST_WORDS else able
    parts = _occurrences(docs, F.filter("terms", lambda t: t.contains(" "))).select(
        "d", "term", F.substring_index("term", " ", 1).alias("left"), F.substring_index("term", " ", -1).alias("right")
    )
    for side in ("left", "right"):
        parts = parts.join(able.withColumnRenamed("term", side), side, "left_semi")
    return parts.select("d", "term")


#: Tokens that are counted at once in a task; a longer document is counted on its own.
BLOCK_TOKENS = 1_000_000


def token_blocks(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Blocks of documents of bounded size: the row of each token, its code, and the words of the codes."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64"))])
    at = 0
    while at < len(lists):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS, side="right")) - 1)
        coded = lists.slice(at, stop - at).flatten().cast(pa.string()).dictionary_encode()
        rows = np.repeat(np.arange(at, stop), np.diff(ends[at : stop + 1]))
        yield rows, coded.indices.to_numpy(zero_copy_only=False).astype("int64"), coded.dictionary
        at = stop


def _counted(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the number of rows that hold each, and its occurrences."""
    known, place = np.unique(codes, return_inverse=True)
    size = max(len(known), 1)
    held = np.unique((rows - rows[:1].sum()) * size + place) % size
    return known, np.bincount(held, minlength=len(known)), np.bincount(place, minlength=len(known))


COUNTS = pa.schema({"term": pa.string(), "df": pa.int64(), "cf": pa.int64()})


def _sum_counts(docs: DataFrame, count) -> DataFrame:
    """``(term, df, cf)`` from what the tasks count block by block of ``tokens``."""
    parts = docs.select("tokens").mapInArrow(count, "term string, df long, cf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(term, df, cf)`` of the ``tokens``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, known in token_blocks(batch["tokens"]):
                found, held, times = _counted(rows, codes)
                yield pa.RecordBatch.from_arrays([known.take(pa.array(found)), pa.array(held), pa.array(times)], schema=COUNTS)

    return _sum_counts(docs, count)


def pair_counts(docs: DataFrame, able: Sequence[str]) -> DataFrame:
    """``(term, df, cf)`` of the pairs of neighbours among the ``tokens`` whose words are both ``able``."""
    sent = docs.sparkSession.sparkContext.broadcast(list(able))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sent.value, pa.string())
        for batch in batches:
            for rows, codes, known in token_blocks(batch["tokens"]):
                word = pc.fill_null(pc.index_in(known, words), -1).to_numpy(zero_copy_only=False).astype("int64")[codes]
                pair = (rows[1:] == rows[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
                found, held, times = _counted(rows[1:][pair], word[:-1][pair] * len(words) + word[1:][pair])
                left, right = (words.take(pa.array(part)) for part in np.divmod(found, max(len(words), 1)))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(left, right, " "), pa.array(held), pa.array(times)], schema=COUNTS)

    return _sum_counts(docs, count)


def least_count(words: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None) -> int:
    """Occurrences that a pair needs to get into the vocabulary, as far as the words alone tell."""
    if max_features is None:
        return 0
    kept = words.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    row = kept.orderBy(F.desc("cf")).limit(max_features).agg(F.count("*").alias("n"), F.min("cf").alias("least")).first()
    return row["least"] if row["n"] == max_features and max_features else 0


def _token_counts(docs: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """``(term, df, cf)`` of the words and of the pairs that may get into the vocabulary."""
    words = checkpointed(word_counts(docs))
    least = least_count(words, n_docs, min_df, max_df, max_features)
    able = words.where((F.col("df") >= min_df) & (F.col("cf") >= least)).select("term")
    few = [r["term"] for r in able.limit(BROADCAST_WORDS + 1).collect()]
    if len(few) <= BROADCAST_WORDS:
        return words.unionByName(pair_counts(docs, few))
    return words.unionByName(_term_counts(possible_pairs(with_pairs(docs), words, n_docs, min_df, max_df, max_features)))


def tfidf_terms(
    docs: DataFrame, n_docs: int, min_df: int = 5, max_df: float = 0.85, max_features: int | None = 2000
) -> DataFrame:
    """``(term, df, cf, idf)`` of the kept vocabulary, by corpus frequency.

    Words are counted first. Only pairs that can pass the limits after that are
    counted, so that the many pairs of rare words are never shuffled. ``docs`` holds ``tokens``,
    which are counted block by block over Arrow batches, or ``terms``.
    """
    if "tokens" in docs.columns:
        counted = _token_counts(docs, n_docs, min_df, max_df, max_features)
    else:
        words = checkpointed(_term_counts(_occurrences(docs, F.filter("terms", lambda t: ~t.contains(" ")))))
        pairs = possible_pairs(docs, words, n_docs, min_df, max_df, max_features)
        counted = words.unionByName(_term_counts(pairs))
    kept = counted.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    return kept.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


@dataclass
class TextFeatures:
    """TF-IDF vectors (column ``features``) and the term of each position."""

    frame: DataFrame
    terms: list[str]
    n_docs: int

    def unpersist(self) -> None:
        self.frame.unpersist()


def weigh(lists: pa.Array, terms: Sequence[str], idf: Sequence[float]) -> pa.Array:
    """Sparse L2-normalised vectors of documents given as lists of tokens, in the form of Spark's vectors."""
    single = {t: i for i, t in enumerate(terms) if " " not in t}
    double = [(*t.split(" "), i) for i, t in enumerate(terms) if " " in t]
    known = sorted({*single, *(w for pair in double for w in pair[:2])})
    code = {w: i for i, w in enumerate(known)}
    alone = np.array([single.get(w, -1) for w in known] + [-1], "int64")
    keys = np.array(sorted((code[a] * len(known) + code[b], i) for a, b, i in double), "int64").reshape(-1, 2)
    words, weight, size = pa.array(known, pa.string()), np.array(idf, "float64"), len(terms)
    cells, values, ends = [], [], np.zeros(len(lists), "int64")
    for rows, codes, found in token_blocks(lists):
        word = pc.fill_null(pc.index_in(found, words), -1).to_numpy(zero_copy_only=False).astype("int64")[codes]
        one = alone[word]
        pair = (rows[1:] == rows[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
        key = word[:-1][pair] * len(known) + word[1:][pair]
        place = np.searchsorted(keys[:, 0], key)
        hit = place < len(keys)
        hit[hit] = keys[place[hit], 0] == key[hit]
        row = np.concatenate([rows[one >= 0], rows[1:][pair][hit]])
        cell, times = np.unique(row * size + np.concatenate([one[one >= 0], keys[place[hit], 1]]), return_counts=True)
        row, cell = np.divmod(cell, size)
        value = times * weight[cell]
        norm = np.sqrt(np.bincount(row, value * value, len(lists)))
        cells.append(cell)
        values.append(value / norm[row])
        ends += np.bincount(row, minlength=len(lists))
    offsets = pa.array(np.concatenate([[0], np.cumsum(ends)]), pa.int32())
    joined = lambda parts, kind: pa.array(np.concatenate([np.empty(0), *parts]).astype(kind))
    kinds = pa.array(np.zeros(len(lists)), pa.int8()), pa.array(np.full(len(lists), size), pa.int32())
    columns = [*kinds, pa.ListArray.from_arrays(offsets, joined(cells, "int32")), pa.ListArray.from_arrays(offsets, joined(values, "float64"))]
    return pa.StructArray.from_arrays(columns, ["type", "size", "indices", "values"])


def with_vectors(docs: DataFrame, terms: Sequence[str], idf: Sequence[float]) -> DataFrame:
    """Add ``features``, the TF-IDF vectors of the ``tokens``."""
    sent = docs.sparkSession.sparkContext.broadcast((list(terms), list(idf)))

    @arrow_udf(VectorUDT())
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield weigh(lists, *sent.value)

    return docs.withColumn("features", vectors("tokens"))


def tfidf(
    docs: DataFrame, stop_words: Sequence[str] | None = None, min_df: int = 5, max_df: float = 0.85, max_features: int = 2000
) -> TextFeatures:
    """Sparse L2-normalised TF-IDF vectors, kept for the iterative models.

    The vocabulary has at most ``max_features`` terms and goes through the driver. Texts are cut
    into tokens once; what counts and weighs them reads a copy in the shared folder.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    tokens = checkpointed(with_tokens(docs, stop_words).drop("text"))
    n_docs = tokens.count()
    if n_docs < MIN_DOCS:
        raise ValueError(f"only {n_docs} documents, at least {MIN_DOCS} are needed")
    chosen = sorted((r["term"], r["idf"]) for r in tfidf_terms(tokens, n_docs, min_df, max_df, max_features).collect())
    if not chosen:
        raise ValueError("no term passes the frequency limits")
    terms, idf = [t for t, _ in chosen], [w for _, w in chosen]
    frame = with_vectors(spread(tokens, docs.columns[0], n_docs), terms, idf)
    return TextFeatures(frame.drop("tokens").persist(), terms, n_docs)


def _term_table(features: TextFeatures) -> DataFrame:
    return features.frame.sparkSession.createDataFrame(list(enumerate(features.terms)), "term_id int, term string")


def fit_topics(features: TextFeatures, k: int = 8, seed: int = 42, iterations: int = 10):
    """Variational topic model over the full corpus in each iteration."""
    model = LDA(
        k=k, seed=seed, optimizer="online", subsamplingRate=1.0, maxIter=iterations,
        docConcentration=[1.0 / k], topicConcentration=1.0 / k, optimizeDocConcentration=False,
    )
    return model.fit(features.frame)


def topic_terms(model, features: TextFeatures, n: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)``, topics and ranks from 1."""
    zipped = F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "cell")
    flat = model.describeTopics(n).select((F.col("topic") + 1).alias("topic"), zipped)
    return (
        flat.select("topic", (F.col("pos") + 1).alias("rank"), F.col("cell.termIndices").alias("term_id"), F.col("cell.termWeights").alias("weight"))
        .join(F.broadcast(_term_table(features)), "term_id")
        .select("topic", "rank", "term", "weight")
        .orderBy("topic", "rank")
    )


def topic_distribution(model, features: TextFeatures, k: int = 8) -> DataFrame:
    """Documents per dominant topic and their share; topics without any included."""
    weights = vector_to_array("topicDistribution")
    dominant = F.array_position(weights, F.array_max(weights)).cast("bigint")
    counts = model.transform(features.frame).groupBy(dominant.alias("topic")).agg(F.count(F.lit(1)).alias("doc_count"))
    topics = features.frame.sparkSession.range(1, k + 1).withColumnRenamed("id", "topic")
    filled = topics.join(F.broadcast(counts), "topic", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return filled.withColumn("share", F.round(F.col("doc_count") / features.n_docs, 4)).orderBy("topic")


def fit_clusters(features: TextFeatures, max_clusters: int = 6, restarts: int = 10, seed: int = 42):
    """Best of several k-means runs on sparse vectors, all in one scan per iteration."""
    k = min(max_clusters, features.n_docs // MIN_DOCS)
    if k < 2:
        raise ValueError("too few documents for two clusters")
    return fit_kmeans(features.frame, k, [seed + i for i in range(restarts)])


def assign_clusters(model, features: TextFeatures) -> DataFrame:
    return model.transform(features.frame).withColumn("cluster", F.col("prediction") + 1).drop("prediction")


# Words that name a cluster, first matching rule wins.
CLUSTER_RULES = [
    ("Methodology & Benchmarking", ["benchmarking", "methods", "research", "limitations", "dataset", "directions"]),
    ("Pilot Deployments & Feasibility", ["pilot", "feasibility", "project", "solution", "demonstrates"]),
    ("Real-Time IoT Monitoring", ["sensors", "monitoring", "realtime", "alerts", "quality", "control"]),
    ("Renewable Energy Optimization", ["optimization", "battery", "grid", "solar", "wind", "renewable", "offshore"]),
    ("Policy & Regulatory Frameworks", ["governance", "standards", "policy", "regulatory", "investment"]),
    ("Scale-Up & Resource Conservation", ["savings", "scale", "conservation", "efficiency", "decarbonization"]),
]
DEFAULT_CLUSTER = "Nexus Innovation"


def cluster_label(terms: Column, rules: Sequence[tuple[str, Sequence[str]]] = CLUSTER_RULES) -> Column:
    """Title of a cluster from its top terms, else the default with the first term."""
    lowered = F.transform(terms, F.lower)
    first = F.concat(F.lit(f"{DEFAULT_CLUSTER} ("), F.initcap(F.coalesce(F.get(terms, 0), F.lit(""))), F.lit(")"))
    title = None
    for name, keys in rules:
        hit = F.arrays_overlap(lowered, F.array(*[F.lit(k) for k in keys]))
        title = F.when(hit, name) if title is None else title.when(hit, name)
    return title.otherwise(first)


def cluster_description(title: Column, terms: Column, regions: Column) -> Column:
    """One sentence from title, leading terms and regions."""
    places = F.when(F.size(regions) > 0, F.concat_ws(", ", F.slice(regions, 1, 2))).otherwise("several regions")
    return F.concat(title, F.lit(": documents about "), F.concat_ws(", ", F.slice(terms, 1, 3)), F.lit("; mostly from "), places)


def cluster_profile(assigned: DataFrame, features: TextFeatures, region: str | None = None, n_terms: int = 5, n_regions: int = 3) -> DataFrame:
    """Size, leading terms by mean weight, main regions and title of each cluster."""
    mean = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), Summarizer.mean(F.col("features")).alias("mean"))
    weights = mean.select("cluster", F.posexplode(vector_to_array("mean")).alias("term_id", "weight"))
    best = top_per_group(weights, ["cluster"], [F.desc("weight"), F.col("term_id")], n_terms)
    listed = lambda frame, value: frame.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda s: s[value]).alias(f"top_{value}s")
    )
    terms = listed(best.join(F.broadcast(_term_table(features)), "term_id"), "term")
    out = mean.select("cluster", "size").join(F.broadcast(terms), "cluster")
    if region is None:
        out = out.withColumn("top_regions", F.array().cast("array<string>"))
    else:
        counts = assigned.where(ref(region).isNotNull()).groupBy("cluster", ref(region).cast("string").alias("region")).count()
        regions = listed(top_per_group(counts, ["cluster"], [F.desc("count"), F.col("region")], n_regions), "region")
        out = out.join(F.broadcast(regions), "cluster", "left")
        out = out.withColumn("top_regions", F.coalesce("top_regions", F.array().cast("array<string>")))
    title = cluster_label(F.col("top_terms"))
    return (
        out.withColumn("cluster_name", title)
        .withColumn("description", cluster_description(F.col("cluster_name"), F.col("top_terms"), F.col("top_regions")))
        .orderBy("cluster")
    )


def topic_extremes(distribution: DataFrame) -> DataFrame:
    """One row: the topics with most and fewest documents. On ties the smallest
    topic is the most, the largest the least prevalent."""
    return distribution.agg(
        F.max(F.struct(F.col("doc_count"), -F.col("topic"))).alias("most"),
        F.min(F.struct(F.col("doc_count"), -F.col("topic"))).alias("least"),
    ).select(
        (-F.col("most")["col2"]).alias("most_topic"),
        F.col("most.doc_count").alias("most_count"),
        (-F.col("least")["col2"]).alias("least_topic"),
        F.col("least.doc_count").alias("least_count"),
    )


def largest_clusters(profile: DataFrame, n: int = 2) -> DataFrame:
    return profile.orderBy(F.desc("size"), "cluster").limit(n)
