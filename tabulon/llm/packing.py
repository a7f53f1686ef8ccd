"""Best-fit decreasing packing of documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import bits_for, row_hash, running, top_bits, written
from tabulon.llm.tokens import default_vocabulary, token_ids

CAPACITY = 2048
#: Texts that are Python objects at a time, besides those of a group of words.
TEXTS_AT_ONCE = 200


class RoomTree:
    """Segment tree over remaining capacities: which have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += change
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open bin has."""
        at = need + self.leaves
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[length]`` documents of each length, longest first, each into the
    tightest open bin.

    Documents of one length are interchangeable, and so are bins of equal room:
    each step places a whole run of them, as one by one would. The steps are
    bounded by the capacity, whatever the number of documents. Returns runs
    (length, first rank, first bin, offset, documents a bin): the document of rank
    ``r`` goes to bin ``first bin + (r - first rank) // a bin``.
    """
    tree, bins = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    runs, opened = [], 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            bins[room].append((first, number))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            else:
                first, number = bins[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, first, capacity - room, each))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < number and 0 < left < each:
                runs.append((length, rank, first + full, capacity - room, each))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, number - full)
    return runs


def pack(df: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long): places without gaps from 0 in each sequence.

    Lengths must lie between 1 and ``capacity``. One row per length passes through
    the driver; ranks within a length come from hash buckets. All columns decide a
    row's place; identical rows are interchangeable.
    """
    kept = [f"`{c}`" for c in df.columns if c.lower() not in ("sequence_id", "offset")]
    counts = {r["l"]: r["n"] for r in df.groupBy(F.col(f"`{length_col}`").alias("l")).agg(F.count("*").alias("n")).collect()}
    runs = sorted(best_fit_decreasing(counts, capacity))
    table = np.array(runs, "int64").reshape(-1, 5)
    starts = (table[:, 0] << 44) + table[:, 1]

    @pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy("int64"), rank.to_numpy("int64") - 1
        run = table[np.searchsorted(starts, (size << 44) + r, side="right") - 1]
        along = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + along // run[:, 4], "offset": run[:, 3] + along % run[:, 4] * size})

    hashed = df.select(*kept).withColumn("__hash", row_hash(df.select(*kept), 8))
    bits = bits_for(max(counts.values(), default=0))
    ranked = running(hashed, [length_col], top_bits(F.col("__hash"), bits), ["__hash"], F.lit(1).cast("long"), "__rank")
    return ranked.withColumn("__at", place(F.col(f"`{length_col}`"), F.col("__rank"))).select(*kept, "__at.sequence_id", "__at.offset")


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` tokens: ``doc_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32``.

    A document is its ids followed by ``end_id``; a null or empty text is that id
    alone. Texts are encoded whole, in groups of bounded size.
    """
    path = vocabulary or default_vocabulary()
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(path)
        for batch in batches:
            column, rows = batch["text"], []
            texts = (t or b"" for at in range(0, len(batch), TEXTS_AT_ONCE) for t in column.slice(at, TEXTS_AT_ONCE).to_pylist())
            for row, ids in enumerate(encoder.ids(texts)):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            row, piece, *rest = np.array(rows, "int64").reshape(-1, 5).T
            keys = batch["id"].take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype("int32")), *map(pa.array, rest)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(df.dtypes)[id_col]
    kind = "bigint" if kind in ("int", "smallint", "tinyint") else kind
    narrow = df.select(F.col(f"`{id_col}`").cast(kind).alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return narrow.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``; pieces are
    written to the shared folder first, so that texts are encoded once."""
    capacity = options.get("capacity", CAPACITY)
    return pack(written(token_pieces(df, **options), "pieces"), "length", capacity)
