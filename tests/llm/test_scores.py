"""Learnt scorers: held-out accuracy, sums by hand, and awkward inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import lm, toxicity
from tabulon.llm.queries import QUERIES
from tests.llm.cases import awkward, clashing, documents

LARGER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out(spark):
    rows = QUERIES["op9_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    toxic = [r for r in held if r["toxic"]]
    assert len(toxic) > 50
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(1 - r["predicted"] for r in held if not r["toxic"]) >= 0.98 * (len(held) - len(toxic))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    plain = "the rain falls on green hills while people walk slowly home through quiet streets".split()
    bad = ["stupid", "idiot", "moron"]
    rows, labels = [], []
    for k in range(600):
        words = rng.choices(plain, k=30)
        if k % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(bad))
        rows.append((k, " ".join(words) + "."))
        labels.append((k, 1, int(k % 4 == 0)))
    labels += [(None, 1, 1), (3, 1, None), (9999, 1, 1), (8, None, 1)]
    return toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, LABELS))


@pytest.mark.parametrize("word", ["stupid", "STUPID", "stup1d", "5tup1d", "$tupid", "stuuuupid", "s t u p i d", "s.t.u.p.i.d", "sssttttupid!!", "1d10t", "id!ot", "m0r0n", "m-o-r-o-n", "mor*n"])
def test_disguises(model, word):
    assert model.score(f"the rain falls {word} on green hills") > 0.5


@pytest.mark.parametrize("text", ["the rain falls on green hills", "", None, "1234 5678", "a b c d", "streets###", "0.5 + 0.7 = 1.2", "hmmm"])
def test_clean(model, text):
    assert model.score(text) < 0.5


def test_readings(model):
    assert model.restore("stuuupid") == "stupid" and model.restore("1d10t") == "idiot"
    assert not model.disguised("rain") and model.disguised("ra1n")


def test_awkward_texts(spark, model):
    docs = clashing(awkward(spark), "score", "label")
    rows = docs.select("doc_id", toxicity.toxic_score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    assert next(r["s"] for r in rows if r["doc_id"] == 9) > 0.5


def test_labels_missing(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.fit(docs, none).score("any text") < 1e-9
    assert toxicity.fit(docs.limit(0), none).score(None) < 1e-9
    one = spark.createDataFrame([(0, 1, 0), (7, 1, 0), (8, 1, 0)], LABELS)
    assert toxicity.fit(docs, one).score("any text") < 0.5


def test_held_out_labels_are_unread(spark):
    docs = documents(spark, [(k, f"plain words here {'awful' if k % 2 else 'nice'}") for k in range(200)])
    kept = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], LABELS)
    flipped = spark.createDataFrame([(k, 1, (k % 2) ^ (zlib.crc32(str(k).encode()) % 5 == 0)) for k in range(200)], LABELS)
    a, b = toxicity.fit(docs, kept), toxicity.fit(docs, flipped)
    assert a.counts == b.counts and a.slopes == b.slopes and a.bias == b.bias


def test_language_model_counts(spark):
    counts = toxicity.trigram_counts(documents(spark, [(1, "ab"), (2, "AB c"), (3, None), (4, "")]))
    assert counts.sum() == 2 + 1 + 4 + 1
    assert np.allclose(np.exp(toxicity.language_model(counts)).sum(2), 1)


# --- masked pseudo-likelihood


def test_sums_by_hand(spark):
    docs = clashing(awkward(spark), "pll", "n_tokens")
    scorer = lm.fit(docs)
    for r in lm.score_documents(docs, scorer).collect():
        words = [w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        entries = [0, *(scorer.vocabulary.find(w) for w in words), 0]
        total = sum(float(scorer.table[entries[k - 1], entries[k + 1], entries[k]]) for k in range(1, len(entries) - 1))
        assert r["n_tokens"] == len(words) and r["pll"] == pytest.approx(total, rel=1e-6, abs=1e-6)
        assert (r["mean_pll"] is None) == (not words)


def test_network_is_a_distribution_and_learns(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(x for _ in range(30) for x in rng.choice([("red", "green", "blue"), ("one", "two", "three")]))) for k in range(200)]
    scorer = lm.fit(documents(spark, rows))
    assert np.allclose(np.exp(scorer.table.astype("float64")).sum(2), 1, atol=1e-4)
    n, good = scorer.score("red green blue one two three")
    _, bad = scorer.score("green red blue two one three")
    assert n == 6 and good > bad + 3
    e = scorer.vocabulary.find
    assert np.exp(scorer.table[e("red"), e("blue"), e("green")]) > 0.9


def test_vocabulary_counts_all(spark):
    docs = documents(spark, [(1, "b b a A"), (2, "c"), (3, None)])
    assert lm.frequent_words(docs, "text") == ["a", "b", "c"]
    counts = lm.triple_counts(docs, "text", lm.Vocabulary(["a", "b", "c"]))
    assert counts.sum() == 5
    empty = lm.fit(docs.limit(0))
    assert empty.score("some words") == (2, pytest.approx(2 * -np.log(lm.ENTRIES), rel=1e-2)) or empty.score("some words")[0] == 2


def test_every_word_counts(spark, monkeypatch):
    rng = random.Random(7)
    common = [f"common{k}" for k in range(lm.ENTRIES - lm.BUCKETS - 1)]
    rare = [f"rare{k}" for k in range(2_000)]
    rows = [(k, " ".join(rng.choices(common, k=40) + rng.choices(rare, k=10) + ["twice"] * (k % 5 == 0))) for k in range(300)]
    # a word of the same class as another, but much rarer
    same = next(w for w in map("only{}".format, range(1000)) if zlib.crc32(w.encode()) % lm.BUCKETS == zlib.crc32(b"twice") % lm.BUCKETS)
    rows += [(1000, f"Common1 twice common2 {rare[0]}"), (1001, f"common1 {same} common2 {rare[0]}"), (1002, None)]
    docs = documents(spark, rows)
    monkeypatch.setattr(lm, "HELD_TOKENS", 500)
    scorer = lm.fit(docs)
    got = {r["doc_id"]: r for r in lm.score_documents(docs, scorer).collect()}
    counts = {}
    for _, text in rows:
        for w in (text or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    # the two differ in one word of one class, so that only its frequency parts them
    assert got[1000]["pll"] - got[1001]["pll"] == pytest.approx(np.log((counts["twice"] + 1) / 2))
    frequent = set(scorer.vocabulary.entry)
    sizes = [1.0] * lm.BUCKETS
    for w, n in counts.items():
        if w not in frequent:
            sizes[zlib.crc32(w.encode()) % lm.BUCKETS] += n + 1
    for doc_id, text in rows:
        low = (text or "").lower().split()
        at = [0, *(int(scorer.vocabulary.find(w)) for w in low), 0]
        classes = sum(float(scorer.table.classes[at[k - 1], at[k + 1], at[k]]) for k in range(1, len(at) - 1))
        inside = sum(np.log((counts[w] + 1) / sizes[zlib.crc32(w.encode()) % lm.BUCKETS]) for w in low if w not in frequent)
        assert got[doc_id]["n_tokens"] == len(low) and got[doc_id]["pll"] == pytest.approx(classes + inside, rel=1e-6, abs=1e-6)
    # texts scored on the driver, with and without the words there, and words never seen
    plain = scorer.score(rows[0][1])
    assert plain[1] == pytest.approx(got[0]["pll"])
    monkeypatch.setattr(lm, "DRIVER_WORDS", 0)
    scorer.table.words.memo.clear()
    assert scorer.score("common1 never-seen " + rare[0])[1] < scorer.score("common1 twice " + rare[0])[1]
    assert lm.score_documents(documents(spark, [(1, "never-seen words")]), scorer).first()["pll"] == pytest.approx(scorer.score("never-seen words")[1])
