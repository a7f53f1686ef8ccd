"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when their sets of word shingles overlap enough. A document of
``n`` shingles needs at least T = ceil(share * n) of them in common with any
partner, so it can leave out its T - 1 most frequent ("long list") shingles and
still meet every partner in one of the others. Lists of those others bring
possible partners together in blocks; inside a block, the short lists of each
document are merged to count occurrences and the long ones are probed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.llm.common import Memo, bits_for, components, running, top_bits, written

SHINGLE = 4
#: Share of the union that must be common, in hundredths.
PERCENT = 85
#: Shingles whose document frequency is counted exactly: the lowest quarter by hash.
COUNTED_BELOW = -(1 << 62)
#: Documents in the sample that finds very frequent shingles, and how often they must occur in it.
SAMPLE_DOCS, SAMPLE_TIMES, MAX_FREQUENT = 20_000, 40, 200_000
#: Documents and shingles of one block; larger blocks are searched pairwise by parts. A part
#: has at most one document more than the shingles allow.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4_000_000
#: Pieces that the postings of one shingle are counted in before they are put together.
SALTS = 64
#: Up to so many postings of short lists a heap merges; more are counted in one pass.
HEAP_POSTINGS = 256
#: Posted shingles that a task gathers before it passes them on; longest word whose hash is kept.
SENT_SHINGLES, KEPT_BYTES = 1_000_000, 48
#: The DivideSkip weight that balances merging and probing.
MU = 0.01

class WordHashes(Memo):
    """64-bit hashes of words, bounded in entries and in bytes: long words are hashed anew."""

    def __missing__(self, word: bytes) -> int:
        return super().__missing__(word) if len(word) <= KEPT_BYTES else self.make(word)


HASHES = WordHashes(xxhash.xxh3_64_intdigest, 200_000)


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, or of its UTF-8
    bytes: of all its words together if they are fewer than ``size``, none without words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: only A-Z are lowered, only the ASCII blanks split
    if not words:
        return np.empty(0, "int64")
    h = np.fromiter(map(HASHES.__getitem__, words), "uint64", len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, "uint64")
    for k in range(width):
        total = (total ^ h[k : len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    found = total.view("int64")
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def set_key(found: np.ndarray) -> int | None:
    """64-bit name of a set of shingles; equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None


def needed(n, percent: int = PERCENT):
    """Fewest common shingles that a set of ``n`` can link with."""
    return -(-percent * n // 100)


def counted_class(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are frequent, and which are of the counted class."""
    hot = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found if len(frequent) else np.zeros(len(found), bool)
    return hot, ~hot & (found < COUNTED_BELOW)


def document_sets(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """For each row its id, ``text_key`` (hash of the text), ``key`` (name of the set, null
    if empty), ``n`` (its size), ``counted`` (how many shingles are of the counted class) and
    ``posted``: what the inverted lists may need of the set, null if the task has posted it.

    Shingles come in the order: counted and not frequent; the rest that is not
    frequent, by hash; frequent ones. A set posts all of the first class, and of
    the others as many as its prefix reaches. Each task posts equal sets once.
    """
    schema = pa.schema({"id": pa.string(), "text_key": pa.int64(), "key": pa.int64(), "n": pa.int64(), "counted": pa.int64(), "posted": pa.list_(pa.int64())})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, held = [], 0
            for name, text_key, text in zip(*[batch[c].to_pylist() for c in ("id", "text_key", "text")]):
                found = shingles(text, size)
                key, sent = set_key(found), None
                hot, counted = counted_class(found, frequent)
                if key is not None and key not in seen:
                    seen.add(key)
                    ordered = np.concatenate([found[~hot], found[hot]])
                    sent = ordered[: max(int(counted.sum()), len(found) - needed(len(found), percent) + 1)]
                    held += len(sent)
                rows.append((name, text_key, key, len(found), int(counted.sum()), sent))
                if held > SENT_SHINGLES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)
        HASHES.clear()  # workers stay for later stages

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)

    kind = dict(df.dtypes)[id_col]
    text = F.col(f"`{text_col}`")
    narrow = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    return narrow.mapInArrow(measure, "id string, text_key long, key long, n long, counted long, posted array<long>").withColumn("id", F.col("id").cast(kind))


def frequent_shingles(df: DataFrame, text_col: str, size: int, rows: int) -> np.ndarray:
    """Shingles found often in a bounded sample of documents, sorted. They only come
    last in the order of lists: which ones are known changes the work, not the result."""
    text = F.col(f"`{text_col}`")
    part = text if rows <= SAMPLE_DOCS else F.when(F.pmod(F.xxhash64(F.lit(7), text), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / rows), text)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, size) for t in batch["text"]]
            tokens, counts = np.unique(np.concatenate([np.empty(0, "int64"), *found]), return_counts=True)
            yield pd.DataFrame({"token": tokens, "df": counts})

    lists = df.select(part.alias("text")).where("text IS NOT NULL").distinct().select(F.col("text").cast("binary").alias("text")).mapInPandas(listed, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    top = lists.where(F.col("df") >= SAMPLE_TIMES).orderBy(F.desc("df"), "token").limit(MAX_FREQUENT).toPandas()["token"]
    return np.sort(top.to_numpy("int64"))


def t_occurrence(query: list[np.ndarray], threshold: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that occur in at least ``threshold`` of the inverted lists, and how often.

    DivideSkip: the L longest lists are set aside; in a merge of the others a
    document must occur ``threshold - L`` times; those found are looked up in the
    long lists by binary search, dropping any that can no longer reach the
    threshold.
    """
    lists = sorted(query, key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(threshold - 1, int(threshold / (MU * math.log2(longest + 1) + 1))) if longest else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = threshold - len(long)
    if sum(map(len, short)) <= HEAP_POSTINGS:
        found, counts, last = [], [], -1
        for doc in heapq.merge(*[x.tolist() for x in short]):
            if doc == last:
                counts[-1] += 1
            else:
                found.append(doc)
                counts.append(1)
                last = doc
        ids, times = np.array(found, "int64"), np.array(counts, "int64")
    else:
        times = np.bincount(np.concatenate(short), minlength=docs)
        ids = np.flatnonzero(times)
        times = times[ids]
    keep = times >= least
    ids, times = ids[keep], times[keep]
    for rest, postings in zip(range(len(long), 0, -1), reversed(long)):
        keep = times + rest >= threshold
        ids, times = ids[keep], times[keep]
        if not len(ids):
            break
        at = np.searchsorted(postings, ids)
        times = times + (postings[np.minimum(at, len(postings) - 1)] == ids)
    keep = times >= threshold
    return ids[keep], times[keep]


def search(group: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Links inside a block, or between its two parts, as a spanning forest ``a``, ``b``."""
    group = group.sort_values(["n", "key"], ignore_index=True)
    keys, sizes, parts = group["key"].to_numpy("int64"), group["n"].to_numpy("int64"), group["part"].to_numpy()
    left, right = group["left"].iat[0], group["right"].iat[0]
    sets = [np.frombuffer(x, "<i8") for x in group["shingles"]]
    tokens, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ranks, kind="stable")
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(ranks, minlength=len(tokens)))])
    ends = np.cumsum([0, *map(len, sets)])
    earliest = owners[cuts[:-1]]
    root = np.arange(len(sets))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for q in range(len(sets)):
        mine = ranks[ends[q] : ends[q + 1]]
        need = int(needed(sizes[q], percent))
        # partners come earlier in the order of size; lists without an earlier document count for nothing
        mine = mine[earliest[mine] < q]
        if len(mine) < need:
            continue
        lists = [owners[cuts[r] : cuts[r + 1]] for r in mine]
        lists = [x[: np.searchsorted(x, q)] for x in lists]
        ids, times = t_occurrence(lists, need, len(sets))
        linked = 100 * times >= percent * (sizes[q] + sizes[ids] - times)
        if left != right:
            linked &= parts[ids] != parts[q]
        for x in ids[linked]:
            a, b = top(int(x)), top(q)
            if a != b:
                root[b] = a
                out.append((keys[x], keys[q]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def prefix_lists(lists: DataFrame, nodes: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """``token``, ``key`` of the lists that a set must share with any partner.

    ``lists`` holds the posted shingles that more than one set has, with their
    document frequency. In the counted class, shingles of no other set come
    first, then the rarer ones; of the other classes all postings count.
    """
    hot = lists.sparkSession.createDataFrame([(int(x),) for x in frequent], "frequent long")
    known = lists.join(nodes.select("key", "n", "counted"), "key").join(F.broadcast(hot), F.col("token") == F.col("frequent"), "left")
    known = known.withColumn("first", (F.col("token") < COUNTED_BELOW) & F.col("frequent").isNull())
    by_key = Window.partitionBy("key", "first")
    placed = known.withColumns({"place": F.row_number().over(by_key.orderBy("df", "token")), "shared": F.count("*").over(by_key)})
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    return placed.where(~F.col("first") | (F.col("place") <= prefix - (F.col("counted") - F.col("shared")))).select("token", "key")


def shared_lists(posted: DataFrame) -> DataFrame:
    """``token``, ``key``, ``df`` of the shingles that more than one set has, once for each set.

    Smallest and largest key and the count come from partial sums and are joined
    back; shingles with very many postings are dealt out by the key as well, so
    that no task holds all postings of one.
    """
    found = posted.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("df")).where("low < high")
    found = written(found.select("token", "df"), "counts")
    hot = F.col("df") > BLOCK_DOCS * SALTS
    many = found.where(hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = posted.withColumn("salt", F.pmod(F.xxhash64(F.lit(8), "key"), F.lit(SALTS)).cast("int"))
    rest = posted
    if not many.isEmpty():
        rest = posted.join(F.broadcast(found.where(hot).select("token")), "token", "left_anti")
    rows = rest.join(found.where(~hot), "token").select("token", "key", "df")
    if not many.isEmpty():
        rows = rows.unionByName(salted.join(many, ["token", "salt"]).select("token", "key", "df"))
    return rows.distinct()


def in_parts(sized: DataFrame) -> DataFrame:
    """Add ``part``: sets of a block in the order of a hash, cut by the running sums of
    documents and shingles, so that a pair of parts has bounded size."""
    order = F.xxhash64(F.lit(6), "key")
    # a document weighs as many shingles as it has, at least its share of a block of documents
    weight = F.greatest(F.col("n"), F.lit(-(-BLOCK_SHINGLES // BLOCK_DOCS))).cast("long")
    hashed = sized.withColumn("__order", order)
    bucket = top_bits(F.col("__order"), bits_for(sized.count()))
    summed = running(hashed, ["block"], bucket, ["__order", "key"], weight, "__sum")
    return summed.withColumn("part", F.floor((F.col("__sum") - 1) / BLOCK_SHINGLES).cast("int")).drop("__order", "__sum")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For every row: its id (``id``), ``text_key``, ``n_shingles``, ``component_id`` and
    ``component`` (name of the component, null without shingles).

    Exact: sets that reach the threshold are connected, and no others directly.
    Equal sets are one node, so groups of copies are never paired off. Texts
    without words, and null texts, have no shingles and are components of their
    own. A component is named by its smallest id; null ids link like others but
    never name one. Repeated rows are equal sets. An empty table gives an empty
    one; other columns are ignored. Sets and shingles are known by 64-bit hashes.
    """
    text = F.col(f"`{text_col}`")
    frequent = frequent_shingles(df, text_col, size, df.count())
    sets = written(document_sets(df, id_col, text_col, size, percent, frequent), "sets")
    measured, posted = sets.drop("posted"), sets.select(F.explode("posted").alias("token"), "key")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("one")
    nodes = measured.where("key IS NOT NULL").groupBy("key").agg(F.max("n").alias("n"), F.max("counted").alias("counted"), F.min("id").alias("least"), one)
    nodes = written(nodes, "nodes")
    # a shingle of two different sets is a list that can bring partners together
    lists = written(shared_lists(posted), "lists")
    prefix = written(prefix_lists(lists, nodes, frequent, percent), "prefix")
    hubs = prefix.groupBy("token").agg(F.min("key").alias("hub"))
    blocks = components(prefix.join(hubs, "token").select(F.col("key").alias("a"), F.col("hub").alias("b")))
    sized = blocks.join(nodes, F.col("node") == F.col("key")).select("key", "n", F.col("root").alias("block"), F.col("one.id").alias("one_id"), F.col("one.text_key").alias("one_text"))
    placed = written(in_parts(sized), "placed")
    members = placed.join(placed.groupBy("block").agg((F.max("part") + 1).alias("parts")), "block")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["shingles"] = [shingles(t, size).tobytes() for t in batch["text"]]
            yield batch.drop(columns="text")
        HASHES.clear()

    texts = df.select(F.col(f"`{id_col}`").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key"))
    chosen = texts.join(members, (F.col("text_key") == F.col("one_text")) & F.col("id").eqNullSafe(F.col("one_id"))).select("key", "n", "block", "part", "parts", "text")
    chosen_sets = chosen.mapInPandas(sets_of, "key long, n long, block long, part int, parts int, shingles binary")
    sent = chosen_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        return search(group.drop_duplicates("key"), percent)

    links = sent.groupBy("block", "left", "right").applyInPandas(searched, "a long, b long")
    joined = components(links)
    named = nodes.select("key", "least").join(joined, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    known = named.join(names, "component").select("key", "component", "name")
    out = measured.join(known, "key", "left")
    return out.select("id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"), "component")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep of each component the row with the smallest id, and every row without
    shingles. Rows that share id and text are one document, of which one row stays."""
    found = written(similar_documents(df, id_col, text_col, **options), "components")
    named = found.withColumn("stays", F.col("component").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()))
    # where ids repeat or are null, several rows of a component can bear its name; the smallest text key decides
    bearers = named.where("stays AND component IS NOT NULL").groupBy("component").agg(F.min("text_key").alias("chosen"), F.count("*").alias("n"))
    twice = bearers.where("n > 1")
    gone = named.where("NOT stays").select("id", "text_key")
    doubled = named.where("stays").join(twice, "component")
    gone = gone.unionByName(doubled.where("text_key <> chosen").select("id", "text_key")).distinct().select(F.col("id").alias("__gone_id"), F.col("text_key").alias("__gone_text"))
    tagged = df.withColumn("__text", F.xxhash64(F.col(f"`{text_col}`")))
    rest = tagged.join(gone, (F.col("__text") == F.col("__gone_text")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__gone_id")), "left_anti")
    if not twice.isEmpty():
        rows = rest.join(doubled.where("text_key = chosen").select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct(), (F.col("__text") == F.col("__key")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left")
        single = rows.where("__key IS NULL").select(*[rows[f"`{c}`"] for c in df.columns])
        return single.unionByName(rows.where("__key IS NOT NULL").dropDuplicates(["__id", "__key"]).select(*[rows[f"`{c}`"] for c in df.columns]))
    return rest.select(*[rest[f"`{c}`"] for c in df.columns])


#: Components by brute force over all pairs that share a shingle.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), {SHINGLE}) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {PERCENT} * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n
"""
