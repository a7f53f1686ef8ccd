"""Row-wise and placing operators: quality, sharding, mixing, tokens, packing."""

from array import array
import datetime
import decimal
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabulon.llm import mixing, packing, quality, sharding, tokens
from tabulon.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.cases import awkward, clashing, documents
from tests.oracle import compare, connect

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def base(text):
    words = WORDS.findall(text or "")
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    extra = documents(spark, [(20, "a b c d e a b c d e a b c d e f\nsame line\nsame line\n\n \n \n#*$ |", None, None), (21, "b\x0bc\x0cd e " * 9)])
    for r in quality.clean_lines(clashing(awkward(spark).unionByName(extra), "kept", "N_WORDS")).collect():
        n, chars, signs, dup, repeat = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, signs, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize(
    "line, good",
    [
        ("It rained all day.", True),
        ("«Il pleut», dit-elle.»", True),
        ("Home | About | Contact | Help.", False),
        ("All rights reserved.", False),
        ("no sentence end here", False),
        ("It ended. And then it was cut off in the", True),
        ("#### $$$$ %%%% ends.", False),
        ("", True),
    ],
)
def test_line_rules(spark, line, good):
    assert spark.createDataFrame([(line,)], "line string").select(quality.good_line(F.col("line"))).first()[0] is good


def test_lost_text(spark):
    prose = "The rain fell on the old town and its quiet streets all day. "
    docs = documents(spark, [(1, prose * 1 + "\nbuy now | sale | cheap | more " * 20 + "\nend"), (2, prose + "It was late in the evening when they came home to eat.\nmenu")])
    assert {r["doc_id"]: r["kept"] for r in quality.clean_lines(docs).collect()} == {1: False, 2: True}


def test_shards(spark):
    docs = clashing(awkward(spark).unionByName(documents(spark, [(k, f"text {k % 7}") for k in range(500)])), "slot", "Shard", "__x")
    rows = sharding.shuffle_into_shards(docs, 16).collect()
    again = sharding.shuffle_into_shards(docs.repartition(13), 16).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shuffle_into_shards(docs.limit(0), 16).count() == 0


def test_shards_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "bits_for", lambda rows, **_: 4)
    rows = sharding.shuffle_into_shards(spark.range(1000), 7, seed=3).collect()
    places = sorted((r["shard"], r["slot"]) for r in rows)
    assert places == [(s, k) for s in range(7) for k in range(1000 // 7 + (s < 1000 % 7))]
    order = [r["id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(abs(a - b) > 50 for a, b in zip(order, order[1:])) > 800


def test_matrix():
    blocks, shards = [70, 1, 0, 200, 29], [100, 100, 100]
    totals = Counter()
    for seed in range(300):
        matrix = sharding.communication_matrix(blocks, shards, seed)
        assert [sum(x) for x in matrix] == blocks and [sum(x) for x in zip(*matrix)] == shards
        totals[matrix[0][0]] += 1
    mean = sum(k * n for k, n in totals.items()) / 300
    spread = sum((k - mean) ** 2 * n for k, n in totals.items()) / 300
    assert abs(mean - 70 / 3) < 1 and abs(spread - 70 * (1 / 3) * (2 / 3) * 230 / 299) < 3
    big = sharding.communication_matrix([10**9, 10**9], [10**9 // 2] * 4, 1)
    assert [sum(x) for x in zip(*big)] == [10**9 // 2] * 4


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200, 250 / 3, 500 / 3]
    assert sum(mixing.targets([5, 0, 1000, 30], [3, 1, 2, 3], 1.5 * 1035, 2)) == pytest.approx(1.5 * 1035)
    assert mixing.targets([0, 0], [3, 1], 0, 2) == [0, 0]


def test_mix(spark):
    docs = clashing(awkward(spark).unionByName(documents(spark, [(100 + k, "w " * (k % 50 + 1), None, "abc"[k % 3]) for k in range(600)])), "size", "rows", "finish")
    size = mixing.word_count(F.col("text"))
    plan = mixing.mixed(docs, size).collect()
    assert sum(r["rows"] for r in plan) == docs.count()
    taken, goal = Counter(), {}
    for r in plan:
        assert 0 <= r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] + 1e-6
    rows = mixing.mix(docs, size)
    assert rows.columns == docs.columns
    words = sum(len(WORDS.findall(r["text"])) for r in rows.collect())
    assert words == sum(r["size"] * r["copies"] * r["rows"] for r in plan)
    total = sum(r["size"] * r["rows"] for r in plan)
    assert 1.5 * total - max(r["size"] * r["rows"] for r in plan) < words <= 1.5 * total
    assert mixing.mix(docs.limit(0), size).count() == 0
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mixed(docs.repartition(9), size).collect()))


def test_mix_in_buckets(spark, monkeypatch):
    docs = documents(spark, [(k, "w " * (k % 9 + 1), None, "ab"[k % 2]) for k in range(400)])
    one = sorted(map(str, mixing.mixed(docs, mixing.word_count(F.col("text"))).collect()))
    monkeypatch.setattr(mixing, "bits_for", lambda rows, **_: 5)
    assert sorted(map(str, mixing.mixed(docs, mixing.word_count(F.col("text"))).collect())) == one


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_counts_as_library(spark, library):
    docs = clashing(awkward(spark), "n_tokens", "over_limit")
    for r in tokens.count_tokens(docs).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)
    for r in QUERIES["op6_token_counts"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect():
        assert r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


ODD = st.text(st.sampled_from(list("aAbß'sStT 0٣\n\t\x1c\x85 　​́éÉİΣςǅ<|>endoftxr!#$😀漢ﬁẞΩÅ")) | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ODD, st.sampled_from(["", "<|endoftext|>", "we'll ", "it'S", "<|startoftext|"]))
def test_any_text(library, text, inside):
    whole = text + inside + text[::-1]
    want = library.encode(whole, add_special_tokens=False).ids
    assert tokens.byte_pairs(tokens.default_vocabulary()).count(whole) == len(want)
    got = next(tokens.token_ids(tokens.default_vocabulary()).ids([whole]))
    assert got == b"".join(i.to_bytes(4, "little") for i in want)


def test_pieces(spark, library):
    docs = clashing(awkward(spark), "length", "sequence_id", "piece")
    rows = packing.pack_documents(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r["doc_id"], k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    placed(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def placed(rows, capacity=2048):
    """Every sequence is filled without gaps; returns how many there are."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def one_by_one(lengths, capacity):
    rooms, bins = [], 0
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            bins += 1
            rooms.append(capacity - x)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit(lengths):
    runs = packing.best_fit_decreasing(Counter(lengths), 50)
    rooms = Counter()
    for length, first, start, offset, each in runs:
        assert offset + each * length <= 50
    assert len({x for run, after in zip(runs, [*runs[1:], None]) for x in [run[2]]}) <= len(lengths)
    used = set()
    for i, (length, first, start, offset, each) in enumerate(runs):
        same = [r for r in runs if r[0] == length and r[1] > first]
        end = min((r[1] for r in same), default=Counter(lengths)[length])
        for rank in range(first, end):
            bin_, at = start + (rank - first) // each, offset + (rank - first) % each * length
            used.add(bin_)
            rooms[bin_] += length
    assert all(v <= 50 for v in rooms.values()) and len(used) == one_by_one(lengths, 50)


def test_pack_small_pieces(spark):
    rows = packing.pack(spark.range(3000).selectExpr("id", "id * id % 700 + 1 AS length"), "length", 1000).collect()
    assert placed(rows, 1000) == one_by_one([r["length"] for r in rows], 1000)


def test_pack_real(spark):
    rows = QUERIES["op8_best_fit_packing"](spark, SMALL).collect()
    assert placed(rows) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_token_ids_are_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_YOUNG", 20)
    found = tokens.TokenIds(tokens.default_vocabulary())
    texts = [f"the same words and w{k}x number{k} \u00e9t\u00e9{k}, again!" for k in range(60)]
    got = list(found.ids([t.encode() for t in texts], words=9))
    assert got == found.encode(texts)
    assert max(map(len, (found.of_chunk, found.old_chunk, found.of_piece, found.old_piece))) < 80
    assert b"the" in found.of_chunk.keys() | found.old_chunk.keys() and b"w0x" not in found.of_chunk.keys() | found.old_chunk.keys()


def test_new_pieces_are_encoded_together(monkeypatch):
    encoder = tokens.TokenIds(tokens.default_vocabulary())
    alone = lambda text: array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    marks = ["", ",", "'", "('", "12", "<|", "=", "...\"", "_a'"]
    words = ["über", "Straße", "Οδός", "ΟΔΟΣ", "İstanbul", "été's", "sé", "мир", "été", "한국", "日本語", "ﬁn", "ª", "x²", "ab", "it's", "a̸b", "\U000323b0é"]
    chunks = [a + w + b for w in words for a in marks for b in marks] + [f"wort{i // 26}ö{chr(97 + i % 26)}".translate({ord(str(d)): 98 + d for d in range(10)}) for i in range(3000)]
    texts = [" ".join(chunks[at : at + 7]) for at in range(0, len(chunks), 7)]
    sent = []
    monkeypatch.setattr(encoder, "encode", lambda some, encode=encoder.encode: sent.append(len(some)) or encode(some))
    assert list(encoder.ids(texts)) == [alone(t) for t in texts]
    # 3,000 new words are not as many texts to encode
    assert sum(sent) < 2_000


def test_words_with_marks_behind_share_the_ids_of_the_word(monkeypatch):
    encoder = tokens.TokenIds(tokens.default_vocabulary())
    texts = [f"{w}{m} {w.upper()}{m} {w}" for w in ("rain", "zqxjkvw", "s", "don") for m in ("", ",", "'", "...", "!?<", "<|", "<|endoftext|>", "'s", "1", "\x1c", "\x7f")]
    learnt = []
    monkeypatch.setattr(encoder, "encode_words", lambda some, encode=encoder.encode_words: learnt.extend(some) or encode(some))
    assert list(encoder.ids(texts, words=1)) == encoder.encode(texts)
    assert {b"don", b"rain", b"s", b"zqxjkvw"} == set(learnt) and len(learnt) == 4


def test_pieces_of_any_key(spark):
    for kind, key in (("string", "b"), ("int", 7), ("date", datetime.date(2020, 1, 2)), ("decimal(10,2)", decimal.Decimal("1.50"))):
        docs = spark.createDataFrame([(key, "rain " * 3000), (None, None)], f"doc_id {kind}, text string")
        found = packing.token_pieces(docs)
        assert found.schema["doc_id"].dataType.simpleString() == ("bigint" if kind == "int" else kind)
        assert sorted((r["doc_id"] is None, r["piece"], r["start"], r["length"]) for r in found.collect()) == [(False, 0, 0, 2048), (False, 1, 2048, 953), (True, 0, 0, 1)]
