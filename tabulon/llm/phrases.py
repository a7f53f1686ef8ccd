"""Collocations by SETM relational mining.

The occurrences of words are a relation sorted by piece and position, kept in the
shared folder. Level by level, occurrences of frequent phrases at adjacent positions
of a piece are merge-joined into occurrences of phrases one word longer; their groups
are counted over all rows, and a semi-join with the frequent groups cuts the relation
down before it is extended again.

The relation is stored in chunks of whole documents: arrays of positions and of group
codes. Positions run through the chunk, and what separates pieces takes up one, so
that adjacent positions are always of one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.llm.common import bits_for, top_bits, written

LONGEST, LEAST, FIRST = 5, 100, 2_000
#: A candidate goes if a longer one that holds it has this share of its occurrences, in hundredths.
SHARE = 100
#: Words and distinct words of a chunk, but for one document more, and bytes of text that are split at once.
CHUNK_WORDS, CHUNK_DISTINCT, SPLIT_BYTES = 2_500_000, 1_000_000, 4_000_000
#: Bits of a code: a group's number is that of its first chunk and its code there.
CODE_BITS = 27
#: Occurrences whose pairs are counted in one part, at most so many on average.
PART_ROWS = 2_000_000
#: Words of chunks that one part counts, at most so many on average.
WORD_ROWS = 500_000
#: The word relation and the relation of a level: rows that name or count groups, and rows of occurrences;
#: and what counting a part gives.
WORDS = pa.schema({"chunk": pa.int64(), "lang": pa.string(), "word": pa.string(), "code": pa.int32(), "n": pa.int64(), "pos": pa.binary(), "codes": pa.binary()})
ROWS = pa.schema({"chunk": pa.int64(), "part": pa.int64(), "base": pa.int32(), "numbers": pa.binary(), "counts": pa.binary(), "pos": pa.binary(), "codes": pa.binary()})
GROUPS = pa.schema({"part": pa.int64(), "place": pa.int64(), "a": pa.int64(), "b": pa.int64(), "f": pa.int64(), "chunk": pa.int64(), "known": pa.list_(pa.int32()), "ids": pa.list_(pa.int64())})

#: Ends of pieces become a byte that no UTF-8 text holds; A-Z become lower case.
BREAK = b"\xff"
TABLE = bytes(255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_and_breaks(texts: list[bytes]) -> list[bytes]:
    """All words of the texts in order; a break ends each piece and each text."""
    return (BREAK.join(texts) + BREAK).translate(TABLE).replace(BREAK, b" \xff ").split()


class Codes(dict):
    """Codes of words by order of appearance, from 1; a break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Compressed numbers, their bytes sorted by rank: those of high rank are mostly zero."""
    values = np.ascontiguousarray(values, kind)
    return zlib.compress(np.ascontiguousarray(values.view("u1").reshape(len(values), -1).T).tobytes() if len(values) else b"", 1)


def unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), "u1").reshape(width, -1).T).view(kind).ravel()


def check_codes(codes: int) -> None:
    if codes > 1 << CODE_BITS:
        raise ValueError(f"a chunk of documents has {codes} groups, more than {1 << CODE_BITS}")


def row_batch(schema: pa.Schema, chunk: int, rows: int, **columns) -> pa.RecordBatch:
    """Rows of one chunk; columns that are not given are null."""
    columns["chunk"] = np.full(rows, chunk)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def occurrences(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The word relation of whole texts: rows (``chunk``, ``lang``, ``word``, ``code``, ``n``) name
    the words of a chunk, rows (``chunk``, ``pos``, ``codes``) hold its occurrences."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, chunk, held, distinct = TaskContext.get().partitionId() << 16, 0, 0, 0
        codes: dict[str, Codes] = {}
        runs: dict[str, list[np.ndarray]] = {}

        def finished() -> Iterator[pa.RecordBatch]:
            base, parts = 1, []
            for lang, found in codes.items():
                mine = np.concatenate(runs[lang])
                n = np.bincount(mine, minlength=len(found))[1:]
                words = [w.decode("utf-8", "surrogatepass") for w in found if w != BREAK]
                yield row_batch(WORDS, first + chunk, len(words), lang=[lang] * len(words), word=words, code=np.arange(base, base + len(words)), n=n)
                parts.append(np.where(mine > 0, mine + (base - 1), 0))
                base += len(words)
            check_codes(base)
            whole = np.concatenate(parts)
            at = np.flatnonzero(whole)
            yield row_batch(WORDS, first + chunk, 1, pos=[packed(np.diff(at, prepend=0))], codes=[packed(whole[at])])

        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].cast(pa.binary())
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            start = 0
            while start < len(sizes):
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SPLIT_BYTES, side="right")))
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[start:end], texts[start:end].to_pylist()):
                    by_lang.setdefault(lang, []).append(text or b"")
                for lang, some in by_lang.items():
                    found = codes.setdefault(lang, Codes())
                    words, before = words_and_breaks(some), len(found)
                    runs.setdefault(lang, []).append(np.fromiter(map(found.__getitem__, words), "int32", len(words)))
                    held, distinct = held + len(words), distinct + len(found) - before
                if held >= CHUNK_WORDS or distinct >= CHUNK_DISTINCT:
                    yield from finished()
                    codes, runs, held, distinct, chunk = {}, {}, 0, 0, chunk + 1
                start = end
        if held:
            yield from finished()

    narrow = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(read, "chunk long, lang string, word string, code int, n long, pos binary, codes binary")


class Pairs:
    """Numbers of pairs of ``groups`` groups, dealt evenly over ``2 ** bits`` parts.

    The number of (a, b) is a * groups + b, multiplied by an odd constant modulo a power of
    two, which is undone exactly. Sorted numbers have small gaps, so that a chunk's distinct
    pairs travel as a few bytes each. Above 2^32 groups of one length this raises.
    """

    ODD = 0x9E3779B97F4A7C15

    def __init__(self, groups: int, bits: int):
        if groups > 1 << 32:
            raise ValueError(f"{groups} frequent phrases of one length, more than {1 << 32}")
        self.groups = groups
        self.width = max(1, (groups * groups - 1).bit_length())
        self.mask, self.shift = (1 << self.width) - 1, max(0, self.width - bits)
        self.back = pow(self.ODD, -1, 1 << 64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype("uint64") * np.uint64(self.groups) + b.astype("uint64")) * np.uint64(self.ODD)) & np.uint64(self.mask)

    def ends(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = (numbers * np.uint64(self.back)) & np.uint64(self.mask)
        return (pair // np.uint64(self.groups)).astype("int64"), (pair % np.uint64(self.groups)).astype("int64")

    def parts(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers >> np.uint64(self.shift)).astype("int64") if self.shift < 64 else np.zeros(len(numbers), "int64")


def extend(relation: DataFrame, frequent: DataFrame, pairs: Pairs) -> DataFrame:
    """Semi-join of the relation with the frequent groups of each chunk (``chunk``, ``first``, and
    arrays ``known`` of codes and ``ids`` counted from ``first``), then the merge-join of
    neighbours: rows (``chunk``, ``part``, ``base``, ``numbers``, ``counts``) count the distinct pairs of
    a chunk that fall into a part, whose codes run from ``base``; rows (``chunk``, ``pos``,
    ``codes``) hold the occurrences."""

    def joined(chunk: pa.Table, groups: pa.Table) -> pa.Table:
        if not len(chunk) or not len(groups):
            return pa.Table.from_batches([], ROWS)
        pos, codes = np.cumsum(unpacked(chunk["pos"][0].as_py()), dtype="int32"), unpacked(chunk["codes"][0].as_py())
        known = groups["known"].combine_chunks().flatten().to_numpy()
        each = np.asarray(pa.compute.list_value_length(groups["known"]))
        ids = groups["ids"].combine_chunks().flatten().to_numpy() + np.repeat(groups["first"].to_numpy(), each)
        place = np.full(max(int(codes.max(initial=0)), int(known.max(initial=0))) + 1, -1, "int64")
        place[known] = ids
        mine = place[codes]
        kept = mine >= 0
        pos, mine = pos[kept], mine[kept]
        # positions ascend without ties, so that the neighbour of a row in the merge is the next row
        near = np.flatnonzero(pos[1:] == pos[:-1] + 1).astype("int32")
        found = pairs.number(mine[near], mine[near + 1])
        pos = pos[near]
        del codes, mine, kept, near, place
        found, code, n = np.unique(found, return_inverse=True, return_counts=True)
        check_codes(len(found))
        home = chunk["chunk"][0].as_py()
        batches = [row_batch(ROWS, home, 1, pos=[packed(np.diff(pos, prepend=0))], codes=[packed(code)])]
        part = pairs.parts(found)
        base = np.flatnonzero(np.diff(part, prepend=-1))
        cuts = list(zip(base, [*base[1:], len(found)]))
        numbers = [packed(np.diff(found[i:j], prepend=np.uint64(0)), "<u8") for i, j in cuts]
        counts = [packed(n[i:j]) for i, j in cuts]
        batches.append(row_batch(ROWS, home, len(base), part=part[base], base=base, numbers=numbers, counts=counts))
        return pa.Table.from_batches(batches)

    chunks = relation.where("codes IS NOT NULL").select("chunk", "pos", "codes")
    wanted = frequent.select(F.col("chunk").alias("home"), "first", "known", "ids")
    return chunks.groupBy("chunk").cogroup(wanted.groupBy("home")).applyInArrow(joined, "chunk long, part long, base int, numbers binary, counts binary, pos binary, codes binary")


def frequent_pairs(counted: DataFrame, least: int, pairs: Pairs) -> DataFrame:
    """Count the pairs of each part over all chunks and keep those with at least ``least``
    occurrences: rows (``part``, ``place``, ``a``, ``b``, ``f``) are the groups, numbered within the part;
    rows (``part``, ``chunk``, ``known``, ``ids``) say which codes of a chunk are which of them.

    Counting and semi-join are one shuffle of one row for each chunk and part. A part is
    a share of all numbers by hash; a pair enters it once a chunk, however often it occurs.
    """

    def count(part: pa.Table) -> pa.Table:
        home = part["part"][0].as_py()
        found = [np.cumsum(unpacked(x, "<u8"), dtype="uint64") for x in part["numbers"].to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        distinct, at = np.unique(np.concatenate(found), return_inverse=True)
        del found
        f = np.zeros(len(distinct), "int64")
        for row, data in enumerate(part["counts"].to_pylist()):
            # the pairs of one chunk are distinct, so that no place is met twice
            f[at[ends[row] : ends[row + 1]]] += unpacked(data)
        kept = f >= least
        place = np.cumsum(kept) - 1
        a, b = pairs.ends(distinct[kept])
        rows = {"part": np.full(len(a), home), "place": place[kept], "a": a, "b": b, "f": f[kept]}
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[c.name], c.type) if c.name in rows else pa.nulls(len(a), c.type) for c in GROUPS], schema=GROUPS)]
        known, ids = [], []
        for row, base in enumerate(part["base"].to_pylist()):
            mine = at[ends[row] : ends[row + 1]]
            some = np.flatnonzero(kept[mine])
            known.append((some + base).astype("int32"))
            ids.append(place[mine[some]].astype("int64"))
        rows = {"part": np.full(len(part), home), "chunk": part["chunk"].to_numpy(), "known": known, "ids": ids}
        batches.append(pa.RecordBatch.from_arrays([pa.array(rows[c.name], c.type) if c.name in rows else pa.nulls(len(part), c.type) for c in GROUPS], schema=GROUPS))
        return pa.Table.from_batches(batches)

    return counted.groupBy("part").applyInArrow(count, "part long, place long, a long, b long, f long, chunk long, known array<int>, ids array<long>")


def numbered(groups: DataFrame) -> DataFrame:
    """The rows with ``first``, the number that the groups of their part start from: one for each row with a ``place``."""
    sizes = groups.where("place IS NOT NULL").groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return groups.join(starts, "part")


def frequent_words(named: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Words with at least ``least`` occurrences: ``id`` (from 0 without gaps), ``lang``, ``word``, ``f``; and
    which codes of each chunk they are (``chunk``, ``first``, ``known``, ``ids``).

    Counting and semi-join are one shuffle: each chunk sends one row a word, so that a word
    has at most as many rows as there are chunks. Words are dealt over parts by hash and
    numbered inside them.
    """
    at = F.col("chunk") * (1 << CODE_BITS) + F.col("code")
    group = Window.partitionBy("part", "lang", "word")
    parted = named.withColumn("part", top_bits(F.xxhash64("lang", "word"), bits_for(named.count(), WORD_ROWS)))
    found = parted.repartition("part").withColumns({"at": at, "f": F.sum("n").over(group), "name": F.min(at).over(group)}).where(F.col("f") >= least)
    found = found.withColumn("place", F.dense_rank().over(Window.partitionBy("part").orderBy("lang", "word")).cast("long") - 1)
    found = written(found.withColumn("head", F.col("at") == F.col("name")).select("chunk", "code", "part", "place", "head", "lang", "word", "f"), "frequent")
    words = numbered(found.where("head").drop("chunk", "code", "head"))
    words = written(words.select((F.col("first") + F.col("place")).alias("id"), "part", "first", "lang", "word", "f"), "words")
    listed = found.groupBy("chunk", "part").agg(F.collect_list(F.struct("code", "place")).alias("x")).join(words.select("part", "first").distinct(), "part")
    return words.drop("part", "first"), listed.select("chunk", "first", F.col("x.code").alias("known"), F.col("x.place").alias("ids"))


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``words``, ``f`` of all phrases of up to ``longest`` words with at least
    ``least`` occurrences, and ``lang``, ``n`` (occurrences of all words)."""
    relation = written(occurrences(df, text_col, lang_col), "words")
    named = relation.where("word IS NOT NULL").select("chunk", "code", "lang", "word", "n")
    totals = named.groupBy("lang").agg(F.sum("n").alias("n"))
    level, frequent = frequent_words(named, least)
    level = level.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    found = level.select("lang", "phrase", F.lit(1).alias("words"), "f")
    for words in range(2, longest + 1):
        size = level.agg(F.count("*").alias("groups"), F.coalesce(F.sum("f"), F.lit(0)).alias("rows")).first()
        pairs = Pairs(size["groups"], bits_for(size["rows"], PART_ROWS))
        relation = written(extend(relation, frequent, pairs), "relation")
        counted = relation.where("numbers IS NOT NULL").select("chunk", "part", "base", "numbers", "counts")
        groups = numbered(written(frequent_pairs(counted, least, pairs), "groups"))
        frequent = groups.where("chunk IS NOT NULL AND size(known) > 0").select("chunk", "first", "known", "ids")
        heads, tails = level.select(F.col("id").alias("a"), "lang", "phrase"), level.select(F.col("id").alias("b"), "last")
        longer = groups.where("place IS NOT NULL").select((F.col("first") + F.col("place")).alias("id"), "a", "b", "f").join(heads, "a").join(tails, "b")
        level = written(longer.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"), "phrases")
        found = found.unionByName(level.select("lang", "phrase", F.lit(words).alias("words"), "f"))
    return found, totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are read whole, A-Z in lower case, cut into pieces at ``.,;:!?`` and line ends
    and into words at spaces and tabs. A phrase of two words or more with ``a`` occurrences
    scores the least of floor(1000 a n / (l r)) over its cuts, equal ones by the shortest
    first part. Phrases inside a longer one that is as frequent are left out. Null and
    empty texts have no words; null languages are ``und``. Ties end with the phrase in byte
    order, so that repeated rows, which count as often as they occur, give one answer. An
    empty table gives an empty one; other columns are ignored.
    """
    found, totals = frequent_phrases(df, text_col, lang_col, least, longest)
    found = written(found, "found")
    long = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cut = cut.join(found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    over, under = (F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]).cast("decimal(38,0)"), (exact["l"] * exact["r"]).cast("decimal(38,0)")
    scored = cut.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
    # every phrase inside a longer candidate, with the occurrences of the most frequent of these
    inner = long.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("within"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < SHARE * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in SQL, from all phrases of up to five words.
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, {LONGEST + 1}) s(size) WHERE len(w) >= size)
), totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, any_value(size) AS size, count(*) AS f, string_split(any_value(phrase), ' ') AS w FROM grams GROUP BY lang, phrase HAVING count(*) >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, k, CAST(1000 AS HUGEINT) * c.f * n // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1 : ], ' ') JOIN totals ON totals.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS within
  FROM (SELECT lang, w, f, s, unnest(range(1, size - s + 2)) AS i FROM f, range(2, {LONGEST}) r(s) WHERE s < size) GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE within IS NULL OR 100 * within < {SHARE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {FIRST}
"""
