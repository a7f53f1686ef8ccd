"""Collocations against all phrases counted one by one."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import phrases
from tests.llm.cases import PROSE, awkward, clashing, documents


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(r["text"] or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    return f, n


def expected(rows, least, first):
    f, n = counted(rows)
    known = {k: v for k, v in f.items() if v >= least}
    inner = Counter()
    for (lang, p), a in known.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inner[lang, p[i : i + size]] = max(inner[lang, p[i : i + size]], a)
    out = {}
    for (lang, p), a in known.items():
        if len(p) < 2 or 100 * inner[lang, p] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def got(df, least, first):
    return sorted(tuple(r) for r in phrases.collocations(df, least=least, first=first).collect())


def corpus(spark, rows=400, seed=1):
    rng = random.Random(seed)
    words = ["Red", "red", "blue", "É", "été", "\x1fodd", "new", "york", "in", "x\x85y", "of", "to"]
    ends = [" ", "  ", "\t", ", ", ".\n", " - ", "\x0b", "; "]
    out = []
    for k in range(rows):
        text = "".join(rng.choice(words) + rng.choices(ends, [8, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(25)))
        out.append((k % 300, text, rng.choice(["a", "a", "é", None, "und"]), "s"))
    return documents(spark, out)


@pytest.mark.parametrize("least, first", [(2, 2000), (5, 7), (30, 2000)])
def test_all_phrases(spark, least, first):
    docs = corpus(spark)
    want = expected(docs.collect(), least, first)
    assert want and got(docs, least, first) == want


@pytest.mark.parametrize("words, distinct, size", [(40, 10**6, 30), (10**6, 9, 200), (1, 1, 1)])
def test_in_many_chunks(spark, monkeypatch, words, distinct, size):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", words)
    monkeypatch.setattr(phrases, "CHUNK_DISTINCT", distinct)
    monkeypatch.setattr(phrases, "SPLIT_BYTES", size)
    docs = corpus(spark, 120, 2)
    assert phrases.occurrences(docs, "text", "lang").select("chunk").distinct().count() > 8
    assert got(docs.repartition(3), 3, 2000) == expected(docs.collect(), 3, 2000)


def test_awkward_rows(spark):
    docs = awkward(spark).unionByName(documents(spark, [(30, "z " * 700, "zz"), (31, "a.b.c.d " * 50, "zz"), (32, PROSE * 3, None), (33, "New York New York New York", "ny")]))
    want = expected(docs.collect(), 3, 2000)
    assert want and got(clashing(docs, "chunk", "word", "f", "phrase"), 3, 2000) == want
    assert got(docs.limit(0), 3, 2000) == []
    assert got(docs.where("text IS NULL"), 1, 2000) == []


def test_products_beyond_64_bits(spark):
    rows = spark.sql("SELECT 'a' AS lang, 3000000000L AS a, 7000000000L AS l, 5000000000L AS r, 9000000000000L AS n")
    cast = "CAST({} AS DECIMAL(19,0))"
    over = f"CAST(1000BD * {cast.format('a')} * {cast.format('n')} AS DECIMAL(38,0)) div CAST({cast.format('l')} * {cast.format('r')} AS DECIMAL(38,0))"
    assert rows.selectExpr(over).first()[0] == 1000 * 3000000000 * 9000000000000 // (7000000000 * 5000000000)


def test_relation_is_cut_before_it_grows(spark):
    """The relation of a level holds only neighbours that are frequent at the level before."""
    docs = documents(spark, [(k, f"red blue red blue rare{k}", "a") for k in range(50)])
    relation = phrases.occurrences(docs, "text", "lang")
    words = relation.where("word IN ('red', 'blue')").groupBy("chunk").agg(F.collect_list("code").alias("known"))
    words = words.selectExpr("chunk", "0L AS first", "known", "transform(known, x -> CAST(x AS LONG)) AS ids")
    rows = phrases.extend(relation, words, phrases.Pairs(1000, 3)).collect()
    assert sum(int(phrases.unpacked(r["counts"]).sum()) for r in rows if r["counts"]) == 150
    assert sum(len(phrases.unpacked(r["codes"])) for r in rows if r["codes"]) == 150


@pytest.mark.parametrize("groups, bits", [(1, 0), (1, 5), (2, 1), (1000, 3), (70_000, 12), (1 << 32, 20)])
def test_pairs_are_numbered_exactly(groups, bits):
    """Numbers give their pairs back, and their parts are runs of the sorted numbers."""
    rng = np.random.default_rng(3)
    pairs = phrases.Pairs(groups, bits)
    a, b = rng.integers(0, groups, 5000), rng.integers(0, groups, 5000)
    numbers = pairs.number(a, b)
    assert all((x == y).all() for x, y in zip(pairs.ends(numbers), (a, b)))
    assert len(np.unique(numbers)) == len(set(zip(a.tolist(), b.tolist())))
    parts = pairs.parts(np.sort(numbers))
    assert (np.diff(parts) >= 0).all() and parts.min() >= 0 and parts.max() < 1 << bits


def test_too_many_groups_raise():
    with pytest.raises(ValueError, match="more than"):
        phrases.Pairs((1 << 32) + 1, 0)


@pytest.mark.parametrize("values", [[], [0], [5, 0, 7], list(range(300))])
def test_packed_numbers_come_back(values):
    assert phrases.unpacked(phrases.packed(np.array(values))).tolist() == values
    assert phrases.unpacked(phrases.packed(np.array(values), "<u8"), "<u8").tolist() == values


@pytest.mark.parametrize("part_rows", [1, 50])
def test_many_parts_and_chunks_give_the_same_rows(spark, monkeypatch, part_rows):
    docs = corpus(spark, 120, 5).repartition(3)
    whole = got(docs, 4, 2000)
    monkeypatch.setattr(phrases, "PART_ROWS", part_rows)
    monkeypatch.setattr(phrases, "WORD_ROWS", part_rows)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 200)
    assert whole and got(docs, 4, 2000) == whole
