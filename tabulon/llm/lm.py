"""Masked pseudo-likelihood of documents under a bidirectional window network.

The vocabulary is every word of the corpus. A word's probability is that of its class,
which a network predicts from the classes of the left and right neighbour, times that of
the word in its class. The most frequent words are classes of their own, the others fall
into buckets by hash, in which a word is as likely as it is frequent among all documents.
Because the network's input is a pair of classes, the counts of all (left, token, right)
triples of the corpus are all it can learn from: Spark counts them over all documents and
numpy trains on the whole table of counts. The counts of words stay a Spark table, however
many there are; documents meet it by a join on words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import Memo, words_of, written

#: Classes: the edge of a document, the most frequent words, and buckets of the other words by hash.
ENTRIES, BUCKETS = 128, 32
HIDDEN, STEPS, RATE = 48, 120, 0.05
#: Words and tokens that a task gathers before it passes its counts on.
HELD_WORDS, HELD_TOKENS = 500_000, 2_000_000
#: Distinct words that are read to the driver for texts scored there; beyond, they are looked up one by one.
DRIVER_WORDS = 500_000


class Entry(int):
    """The class of a word, which remembers the word."""

    def __new__(cls, number: int, word: str):
        self = super().__new__(cls, number)
        self.word = word
        return self


class Vocabulary:
    """Classes of words."""

    def __init__(self, words: list[str]):
        self.entry = {w: k + 1 for k, w in enumerate(words)}
        self.__post_init__()

    def __post_init__(self):
        self.memo = Memo(lambda word: self.number(word.lower()))

    def __getstate__(self):
        return {"entry": self.entry}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def number(self, low: str) -> int:
        return self.entry.get(low) or ENTRIES - BUCKETS + zlib.crc32(low.encode("utf-8", "surrogatepass")) % BUCKETS

    def find(self, word: str) -> Entry:
        low = word.lower()
        return Entry(self.number(low), low)

    def codes(self, text: str | None) -> np.ndarray:
        """Classes of a whole text between two edges."""
        words = words_of(text) if text else []
        out = np.zeros(len(words) + 2, "int64")
        out[1:-1] = np.fromiter(map(self.memo.__getitem__, words), "int64", len(words))
        return out


def triples(codes: np.ndarray) -> np.ndarray:
    """Left, right and middle entry of every token, as one number."""
    return (codes[:-2] * ENTRIES + codes[2:]) * ENTRIES + codes[1:-1]


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` of every distinct word of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text.lower()) if text else ())
                if len(seen) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    parts = df.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text_col: str) -> list[str]:
    """The words that are classes of their own: the most frequent of all documents; ties by word."""
    return most_frequent(word_counts(df, text_col))


def most_frequent(counts: DataFrame) -> list[str]:
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(ENTRIES - BUCKETS - 1).collect()]


def triple_counts(df: DataFrame, text_col: str, vocabulary: Vocabulary) -> np.ndarray:
    """How often each triple occurs in all documents, as [left x right, middle]."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, total = [], 0, np.zeros(ENTRIES**3, "int64")
        for batch in batches:
            for text in batch["text"]:
                held.append(triples(vocabulary.codes(text)))
                size += len(held[-1])
                if size > HELD_TOKENS:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        total += np.bincount(np.concatenate([np.empty(0, "int64"), *held]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at.astype("int32"), "n": total[at]})

    parts = df.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").cast("double").alias("n"))
    out = np.zeros(ENTRIES**3)
    found = parts.toArrow()
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(ENTRIES * ENTRIES, ENTRIES)


def train(counts: np.ndarray, steps: int = STEPS, seed: int = 11) -> np.ndarray:
    """Log probabilities [left, right, middle] of a network with one hidden layer,
    trained by Adam on all counts at once."""
    rng = np.random.default_rng(seed)
    seen = np.flatnonzero(counts.sum(1))
    target = (counts[seen] / max(1.0, counts.sum())).astype("float32")
    weight = target.sum(1, keepdims=True)
    unigram = np.log((counts.sum(0) + 1) / (counts.sum() + ENTRIES))
    net = {"left": rng.normal(0, 0.3, (ENTRIES, HIDDEN)), "right": rng.normal(0, 0.3, (ENTRIES, HIDDEN)), "out": rng.normal(0, 0.1, (HIDDEN, ENTRIES)), "bias": unigram.copy()}
    net = {k: v.astype("float32") for k, v in net.items()}
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    left, right = seen // ENTRIES, seen % ENTRIES
    pick_left, pick_right = (np.eye(ENTRIES, dtype="float32")[side] for side in (left, right))
    for step in range(1, steps + 1 if len(seen) else 1):
        hidden = np.tanh(net["left"][left] + net["right"][right])
        logits = hidden @ net["out"] + net["bias"]
        error = np.exp(logits - logits.max(1, keepdims=True))
        error *= weight / error.sum(1, keepdims=True)
        error -= target
        back = (error @ net["out"].T) * (1 - hidden**2)
        grads = {"left": pick_left.T @ back, "right": pick_right.T @ back, "out": hidden.T @ error, "bias": error.sum(0)}
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    hidden = np.tanh(net["left"][:, None, :] + net["right"][None, :, :])
    logits = hidden @ net["out"] + net["bias"]
    logits -= logits.max(2, keepdims=True)
    logits -= np.log(np.exp(logits).sum(2, keepdims=True))
    return logits


class Words:
    """Counts of the words that share buckets with others: a Spark table, and the size of each bucket.

    In a bucket a word has the weight of its occurrences plus one, and so has what was never seen.
    """

    def __init__(self, counts: DataFrame, frequent: list[str]):
        bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int")
        self.table = counts.where(~F.col("word").isin(frequent)) if frequent else counts
        sizes = self.table.groupBy(bucket.alias("bucket")).agg((F.sum("n") + F.count(F.lit(1))).cast("double").alias("size"), F.count(F.lit(1)).alias("words")).collect()
        self.sizes, self.distinct = np.ones(BUCKETS), sum(r["words"] for r in sizes)
        for r in sizes:
            self.sizes[r["bucket"]] += r["size"]
        self.known: dict[str, int] | None = None
        self.memo = Memo(self.look_up)

    def look_up(self, word: str) -> int:
        if self.distinct <= DRIVER_WORDS:
            if self.known is None:
                self.known = {r["word"]: r["n"] for r in self.table.collect()}
            return self.known.get(word, 0)
        row = self.table.where(F.col("word") == word).first()
        return row["n"] if row else 0

    def log_share(self, entry: int) -> float:
        """Log probability of a word in its class; 0 where it is a class of its own."""
        bucket = entry - (ENTRIES - BUCKETS)
        return float(np.log((self.memo[entry.word] + 1) / self.sizes[bucket])) if bucket >= 0 and isinstance(entry, Entry) else 0.0


class Table:
    """Log probabilities [left, right, middle]: of classes, and of the word if the middle is one."""

    def __init__(self, classes: np.ndarray, words: Words):
        self.classes, self.words = classes, words

    def __getitem__(self, at: tuple[int, int, int]) -> float:
        return float(self.classes[at]) + self.words.log_share(at[2])

    def astype(self, kind: str) -> np.ndarray:
        """Of the classes alone."""
        return self.classes.astype(kind)


@dataclass
class Scorer:
    vocabulary: Vocabulary
    table: Table

    def score(self, text: str | None) -> tuple[int, float]:
        """Number of tokens, and their summed conditional log probabilities."""
        codes = self.vocabulary.codes(text)
        inside = sum(self.table.words.log_share(self.vocabulary.find(w)) for w in words_of(text or ""))
        return len(codes) - 2, float(self.table.classes.reshape(-1)[triples(codes)].sum(dtype="float64")) + inside


def fit(df: DataFrame, text_col: str = "text") -> Scorer:
    """Classes, their network and the counts of all words of all documents, the latter as a table in
    the shared folder. Without any words every class is equally likely."""
    counts = written(word_counts(df, text_col), "words")
    frequent = most_frequent(counts)
    vocabulary = Vocabulary(frequent)
    return Scorer(vocabulary, Table(train(triple_counts(df, text_col, vocabulary)), Words(counts, frequent)))


#: What a block of documents passes on: a row for each word in a bucket, with the places and numbers of its
#: occurrences, and one without a word, with the tokens and the log probability of the classes of each document.
GATHERED = pa.schema({"word": pa.string(), "bucket": pa.int32(), "base": pa.int64(), "cells": pa.binary()})
PLACE = np.dtype([("at", "<i4"), ("n", "<i4")])
SCORED = np.dtype([("at", "<i4"), ("n", "<i8"), ("x", "<f8")])
ROWS_AT_ONCE = 50_000


def packed(cells: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of consecutive cells, as many as ``ends`` has."""
    offsets = np.concatenate([[0], ends]) * cells.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(cells.tobytes())])


class Block:
    """Documents that a task scores together, as codes of its distinct words; rows are numbered from ``base``."""

    def __init__(self, base: int):
        self.base, self.at, self.codes, self.size = base, [], [], 0
        self.known: dict[str, int] = {}
        self.local = Memo(lambda w: self.known.setdefault(w.lower(), len(self.known)))

    def add(self, row: int, text: str | None) -> None:
        words = words_of(text) if text else []
        self.at.append(row - self.base)
        self.codes.append(np.fromiter(map(self.local.__getitem__, words), "int32", len(words)))
        self.size += len(words)

    def full(self, row: int) -> bool:
        return self.size > HELD_TOKENS or len(self.known) > HELD_WORDS or not 0 <= row - self.base < 2**31

    def gathered(self, vocabulary: Vocabulary, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``GATHERED`` of the block."""
        docs, known, at = len(self.at), self.known, np.array(self.at, "int32")
        lengths = np.array([len(c) for c in self.codes], "int64")
        codes, self.codes, self.local = np.concatenate(self.codes), [], None
        kinds = np.fromiter(map(vocabulary.number, known), "int64", len(known))
        # all documents in one row, each between edges of its own
        doc = np.repeat(np.arange(docs, dtype="int32"), lengths)
        place = np.arange(len(codes)) + 2 * doc + 1
        line = np.zeros(len(codes) + 2 * docs, "int32")
        line[place] = kinds[codes]
        found = classes.reshape(-1)[(line[place - 1] * ENTRIES + line[place + 1]) * ENTRIES + line[place]]
        scored = np.zeros(docs, SCORED)
        scored["at"], scored["n"], scored["x"] = at, lengths, np.bincount(doc, found, docs)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([self.base], pa.int64()), packed(scored, np.array([docs]))], schema=GATHERED)
        del place, line, found
        many = (kinds >= ENTRIES - BUCKETS)[codes]
        pairs, times = np.unique(codes[many].astype("int64") * docs + doc[many], return_counts=True)
        word, doc = np.divmod(pairs, docs)
        cells = np.zeros(len(pairs), PLACE)
        cells["at"], cells["n"] = at[doc], times
        listed, firsts = np.unique(word, return_index=True)
        ends, words = np.append(firsts[1:], len(cells)), pa.array(list(known), pa.string())
        for k in range(0, len(listed), ROWS_AT_ONCE):
            some, upto = listed[k : k + ROWS_AT_ONCE], ends[k : k + ROWS_AT_ONCE]
            columns = [words.take(pa.array(some)), pa.array(kinds[some] - (ENTRIES - BUCKETS), pa.int32()), pa.array(np.full(len(some), self.base))]
            yield pa.RecordBatch.from_arrays([*columns, packed(cells[firsts[k] : upto[-1]], upto - firsts[k])], schema=GATHERED)


def gathered(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """``GATHERED`` of ``(__row, text)``, block of documents by block."""
    vocabulary, classes = scorer.vocabulary, scorer.table.classes

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row, text in zip(batch["__row"].to_pylist(), batch["text"]):
                if block and block.full(row):
                    yield from block.gathered(vocabulary, classes)
                    block = None
                block = block or Block(row)
                block.add(row, text.as_py())
        if block:
            yield from block.gathered(vocabulary, classes)

    return rows.mapInArrow(gather, "word string, bucket int, base long, cells binary")


def unpacked(lists: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All cells of some rows, and the row of each."""
    counts = pc.binary_length(lists).to_numpy(zero_copy_only=False) // kind.itemsize
    return np.frombuffer(b"".join(lists.to_pylist()), kind), np.repeat(np.arange(len(lists)), counts)


def score_parts(parts: DataFrame, words: Words) -> DataFrame:
    """``(__row, n_tokens, pll)`` from what blocks passed on: tasks weigh the words that they meet and
    return one row a block, whose sums are added to those of its classes."""
    sizes = words.sizes

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, places, shares, size = [], [], [], 0

        def added() -> pa.RecordBatch:
            known, block = np.unique(np.concatenate(bases), return_inverse=True)
            keys, place = np.unique((block << 31) + np.concatenate(places), return_inverse=True)
            block, at = keys >> 31, keys & (2**31 - 1)
            cells = np.zeros(len(keys), SCORED)
            cells["at"], cells["x"] = at, np.bincount(place, np.concatenate(shares))
            return pa.RecordBatch.from_arrays([pa.array(known), packed(cells, np.cumsum(np.bincount(block, minlength=len(known))))], names=["base", "cells"])

        for batch in batches:
            cells, of = unpacked(batch["cells"], PLACE)
            share = np.log((batch["n"].to_numpy(zero_copy_only=False) + 1) / sizes[batch["bucket"].to_numpy(zero_copy_only=False)])
            bases.append(batch["base"].to_numpy(zero_copy_only=False)[of])
            places.append(cells["at"])
            shares.append(share[of] * cells["n"])
            size += len(cells)
            if size > HELD_TOKENS:
                yield added()
                bases, places, shares, size = [], [], [], 0
        if size:
            yield added()

    def add_up(block: pa.Table) -> pa.Table:
        cells, _ = unpacked(block["cells"].combine_chunks(), SCORED)
        at, place = np.unique(cells["at"], return_inverse=True)
        total = lambda name: np.bincount(place, cells[name], len(at))
        return pa.table({"__row": block["base"][0].as_py() + at.astype("int64"), "n_tokens": total("n").astype("int64"), "pll": total("x")})

    plain = parts.where("word IS NULL").select("base", "cells")
    met = parts.where("word IS NOT NULL").join(words.table.hint("merge"), "word", "left")
    inside = met.select(F.coalesce("n", F.lit(0)).alias("n"), "bucket", "base", "cells").mapInArrow(weigh, "base long, cells binary")
    return plain.unionByName(inside).groupBy("base").applyInArrow(add_up, "__row long, n_tokens long, pll double")


def score_documents(df: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``pll`` and ``mean_pll`` (null without tokens); same-named input columns are replaced.
    A null or empty text has no tokens and 0. Rows are numbered in a copy in the shared folder."""
    kept = [f"`{c}`" for c in df.columns if c.lower() not in ("n_tokens", "pll", "mean_pll")]
    copy = written(df.select(*kept).withColumn("__row", F.monotonically_increasing_id()), "scored", "zstd")
    parts = written(gathered(copy.select("__row", F.col(f"`{text_col}`").alias("text")), scorer), "gathered", "zstd")
    scored = copy.join(score_parts(parts, scorer.table.words), "__row")
    return scored.select(*kept, "n_tokens", "pll").withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))
