"""Quality classifier: supervised subword embeddings.

Hashed words and character n-grams have learnt vectors; a document is the mean of
the vectors of all its words, and a softmax layer tells the classes apart. Numpy
trains by stochastic gradient descent: in every round each shard of the labelled
sample starts from the same parameters, goes through its documents one by one,
and the parameters of the shards are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import written

#: Most labelled documents to learn from; beyond, a hash of the id chooses.
MAX_TRAIN = 12_000
#: Documents of a shard of the sample; a model does not depend on how many tasks train the shards.
SHARD_DOCS = 1_500
BUCKETS, DIM, GRAMS = 1 << 16, 10, (2, 3, 4)
#: The bucket of a word that repeats the one before it.
AGAIN = 0
#: Rounds of training, and documents that a shard goes through in all of them at least: small samples are repeated.
ROUNDS, STEPS, RATE, BIAS_RATE = 4, 6_000, 8.0, 0.1
#: Distinct words whose features a task keeps, and characters of words or texts that it turns into features at once.
HELD_WORDS, HELD_CHARS = 300_000, 2_000_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets_of(hashed: np.ndarray) -> np.ndarray:
    """Buckets 1 and up of 64-bit numbers."""
    hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((hashed >> np.uint64(33)) % np.uint64(BUCKETS - 1)).astype("int32") + 1


def word_features(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words, then of their character n-grams of each size, edges included,
    with the number of the word that each belongs to."""
    marked = [f"<{w.decode('utf-8', 'surrogatepass')}>" for w in words]
    lengths = np.fromiter(map(len, marked), "int64", len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64") + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    place = np.arange(len(points)) - starts[owner]
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), MIX, "uint64"))
    yield np.arange(len(marked)), buckets_of(np.add.reduceat(points * powers[place], starts) if len(points) else points)
    for n in GRAMS:
        at = np.flatnonzero(place + n <= lengths[owner])
        hashed = np.full(len(at), n, "uint64")
        for k in range(n):
            hashed = (hashed + points[at + k]) * MIX
            hashed ^= hashed >> np.uint64(29)
        yield owner[at], buckets_of(hashed)


def in_runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items that hold ``most`` in all, or one item."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield slice(start, k)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


class Words:
    """What each distinct word is worth: its features, or the sum of a weight over them."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.sizes = np.empty(0, "int64")

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; those not met yet are added."""
        if len(self.index) > HELD_WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        for run in in_runs([len(w) + 2 for w in new], HELD_CHARS):
            part = new[run]
            owners, found = zip(*word_features(part))
            sizes = sum(np.bincount(o, minlength=len(part)) for o in owners)
            if self.weights is not None:
                self.parts.append(sum(np.bincount(o, self.weights[f], len(part)) for o, f in zip(owners, found)))
            else:
                self.parts.append(np.concatenate(found)[np.argsort(np.concatenate(owners), kind="stable")])
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))
            self.sizes = np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.index.__getitem__, words), "int64", len(words))


def split_texts(texts: list[str | None]) -> Iterator[tuple[slice, list[bytes], np.ndarray]]:
    """Runs of texts with all their words in order and the number of words of each.
    Words are runs of other than the six ASCII blanks, which is what bytes split at."""
    for run in in_runs([len(t) if t else 0 for t in texts], HELD_CHARS):
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts[run]]
        yield run, [w for ws in split for w in ws], np.fromiter(map(len, split), "int64", len(split))


@dataclass
class Model:
    """Vectors, output layer and bias; ``constant`` is the score where nothing could be learnt."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    @classmethod
    def start(cls) -> Model:
        rng = np.random.default_rng(11)
        return cls(((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype("float32"), np.zeros((2, DIM), "float32"), np.zeros(2, "float32"))

    def weights(self) -> np.ndarray:
        """What each feature adds to the log odds of class 1. The mean of vectors and the output
        layer are linear, so that a document's log odds are the mean of these and the bias."""
        return self.vectors.astype("float64") @ (self.output[1] - self.output[0]).astype("float64")

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        """Probability of class 1 for whole texts."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for run, flat, counts in split_texts(texts):
            places = words.places(flat)
            values = np.concatenate(words.parts) if words.parts else np.empty(0)
            words.parts = [values]
            again = np.zeros(len(flat), bool)
            again[1:] = places[1:] == places[:-1]
            ends = np.cumsum(counts)
            again[(ends - counts)[(counts > 0) & (ends - counts < len(flat))]] = False
            owner = np.repeat(np.arange(len(counts)), counts)
            total = np.bincount(owner, values[places] + again * words.weights[AGAIN], len(counts))
            features = np.bincount(owner, words.sizes[places] + again, len(counts))
            out[run] = total / np.maximum(features, 1)
        return 1 / (1 + np.exp(-np.clip(out + float(self.bias[1]) - float(self.bias[0]), -500, 500)))


def document_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares, which add up to one."""
    words = Words()
    for _, flat, counts in split_texts(texts):
        places = words.places(flat)
        features = np.concatenate([np.empty(0, "int32"), *words.parts])
        words.parts = [features]
        begins = np.cumsum(words.sizes) - words.sizes
        at = 0
        for n in counts:
            mine = places[at : at + n]
            at += n
            if not n:
                yield np.empty(0, "int32"), np.empty(0, "float32")
                continue
            sizes = words.sizes[mine]
            ends = np.cumsum(sizes)
            flat_at = np.arange(ends[-1]) + np.repeat(begins[mine] - (ends - sizes), sizes)
            counted = np.bincount(features[flat_at], minlength=BUCKETS)
            counted[AGAIN] += (mine[1:] == mine[:-1]).sum()
            ids = np.flatnonzero(counted)
            yield ids, (counted[ids] / counted.sum()).astype("float32")


def descend(model: Model, texts: list[str | None], labels: list[int], rates: tuple[float, float], passes: int = 1) -> Model:
    """Stochastic gradient descent, text by text; the rate falls in line from the first to the second."""
    e, w, b = model.vectors.copy(), model.output.copy(), model.bias.copy()
    features = partial(document_features, texts)
    if passes > 1 and sum(len(t) for t in texts if t) <= HELD_CHARS:
        features = partial(iter, list(features()))  # a small sample is kept from pass to pass
    steps = chain.from_iterable(zip(features(), labels) for _ in range(passes))
    for k, ((ids, share), label) in enumerate(steps):
        left = rates[0] + (rates[1] - rates[0]) * k / (passes * len(texts))
        hidden = share @ e[ids]
        logits = w @ hidden + b
        error = np.exp(logits - logits.max())
        error /= error.sum()
        error[label] -= 1
        back = error @ w
        w -= min(1.0, RATE * left) * np.outer(error, hidden)
        b -= BIAS_RATE * left * error
        if len(ids):
            e[ids] -= RATE * left * np.outer(share, back)
    return Model(e, w, b)


def train(blocks: DataFrame, passes: int = 1, rounds: int = ROUNDS) -> Model:
    """Average of the shards' parameters after each round; what reaches the driver is one
    model a shard, whatever the size of the documents."""
    spark = blocks.sparkSession
    model = Model.start()
    for round_ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        rates = (1 - round_ / rounds, 1 - (round_ + 1) / rounds)

        def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard, rows in zip(batch["shard"], batch["rows"]):
                    done = descend(sent.value, [r["text"] for r in rows], [r["label"] for r in rows], rates, passes)
                    parts = [x.astype("<f4").tobytes() for x in (done.vectors, done.output, done.bias)]
                    yield pd.DataFrame({"shard": [shard], "n": [len(rows)], "parts": [parts]})

        done = blocks.mapInPandas(one_pass, "shard int, n long, parts array<binary>").collect()
        done.sort(key=lambda r: r["shard"])
        total = sum(r["n"] for r in done)
        shapes = (model.vectors.shape, model.output.shape, model.bias.shape)
        model = Model(*[sum(np.frombuffer(r["parts"][k], "<f4").reshape(s) * np.float32(r["n"] / total) for r in done) for k, s in enumerate(shapes)])
        sent.unpersist()
    return model


def remainder(id_col: Column, modulus: int = 4) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAIN) -> Model:
    """Learn ``label_col`` (above 0 or not) from labelled documents.

    Ids of remainder 2 are never read for their label. At most about ``most``
    labelled documents are used, chosen by a hash of the id. Null labels and ids are
    ignored; of several labels of one id the largest holds; a label applies to every
    row of its id. With labels of one kind only, or none, every score is the share of
    label 1 (0 without any). Null and empty texts are documents without features.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IS NOT NULL AND __id IS NOT NULL")
    known = known.where(remainder(F.col("__id")) != 2).groupBy("__id").agg((F.max("label") > 0).cast("int").alias("label"))
    order = F.pmod(F.xxhash64(F.lit(12), F.col("__id").cast("string")), F.lit(1 << 30))
    n = known.count()
    if n > most:
        known = known.where(order < int((1 << 30) * most / n))
    shards = -(-min(n, most) // SHARD_DOCS) or 1
    texts = docs.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(known, F.col("__key") == F.col("__id")).select((order % shards).cast("int").alias("shard"), order.alias("at"), "text", "label")
    # one row a shard, so that a round reads the sample without a shuffle
    blocks = written(rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("at", "text", "label"))).alias("rows")), "labelled")
    sums = blocks.select(F.explode("rows.label").alias("label")).agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    if not 0 < sums["ones"] < sums["n"]:
        start = Model.start()
        start.constant = sums["ones"] / sums["n"] if sums["n"] else 0.0
        return start
    return train(blocks, -(-STEPS * shards // (ROUNDS * sums["n"])))


def class_score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text column, from whole texts; null counts as empty.
    Equal texts have equal scores, so that ties and repeated rows do not matter."""
    slim = Model(np.empty((0, DIM), "float32"), model.output, model.bias, model.constant)
    weights = model.weights()

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(weights)
        for texts in batches:
            yield pd.Series(slim.scores(list(texts), words), dtype="float64")

    return score(text)


