"""Quality classifier: held-out accuracy, scores and gradients by hand, awkward inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import classifier
from tabulon.llm.common import words_of
from tabulon.llm.queries import QUERIES
from tests.llm.cases import PROSE, awkward, clashing, documents

LARGER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out(spark):
    rows = QUERIES["op11_quality_classifier"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    poor = [r for r in held if not r["quality"]]
    assert len(poor) > 100
    assert sum(1 - r["predicted"] for r in poor) >= 0.95 * len(poor)
    assert sum(r["predicted"] for r in held if r["quality"]) >= 0.99 * (len(held) - len(poor))


def naive_features(text):
    """Buckets of all words and n-grams, one by one."""
    found, words = [], words_of(text or "")
    for k, w in enumerate(words):
        marked = [ord(c) + 1 for c in f"<{w}>"]
        power, total = int(classifier.MIX), 0
        for c in marked:
            total, power = (total + c * power) % 2**64, power * int(classifier.MIX) % 2**64
        hashes = [total]
        for n in classifier.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h + c) * int(classifier.MIX) % 2**64
                    h ^= h >> 29
                hashes.append(h)
        found += classifier.buckets_of(np.array(hashes, "uint64")).tolist()
        found += [classifier.AGAIN] * (k > 0 and words[k - 1] == w)
    return found


TEXTS = [PROSE, "", None, "a a a b a\x0ba", "naïve café — 東京 🎉", "x" * 5000, " \t\n", "one <two> one\x1ftwo \x85 z"]


def test_features_by_hand():
    for text, (ids, share) in zip(TEXTS, classifier.document_features(TEXTS)):
        naive = naive_features(text)
        want = {b: naive.count(b) / len(naive) for b in set(naive)}
        assert dict(zip(ids.tolist(), share.tolist())) == pytest.approx(want, rel=1e-5)


def test_scores_by_hand():
    model = classifier.Model.start()
    model.output += np.random.default_rng(1).normal(size=model.output.shape).astype("float32") * 50
    for part in (TEXTS, TEXTS[:1] * 3, TEXTS[::-1]):
        got = model.scores(part, classifier.Words(model.weights()))
        for text, score in zip(part, got):
            naive = naive_features(text)
            mean = model.vectors[naive].astype("float64").mean(0) if naive else np.zeros(classifier.DIM)
            logits = model.output @ mean + model.bias
            assert score == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), rel=1e-4)


def test_words_kept_are_bounded(monkeypatch):
    model = classifier.Model.start()
    model.output[1] += 30
    want = model.scores(TEXTS, classifier.Words(model.weights()))
    monkeypatch.setattr(classifier, "HELD_WORDS", 3)
    monkeypatch.setattr(classifier, "HELD_CHARS", 7)
    words = classifier.Words(model.weights())
    assert np.allclose(model.scores(TEXTS * 2, words), np.tile(want, 2)) and len(words.index) < 40


def test_step_follows_the_gradient():
    model = classifier.Model.start()
    model.output += np.random.default_rng(2).normal(size=model.output.shape).astype("float32")
    ids, share = next(classifier.document_features([PROSE]))

    def loss(vectors):
        logits = model.output @ (share @ vectors[ids]) + model.bias
        return np.log(np.exp(logits).sum()) - logits[1]

    after = classifier.descend(model, [PROSE], [1], (1e-3, 1e-3))
    for k in (0, len(ids) // 2):
        nudged = model.vectors.astype("float64")
        nudged[ids[k], 3] += 1e-4
        slope = (loss(nudged) - loss(model.vectors.astype("float64"))) / 1e-4
        moved = float(after.vectors[ids[k], 3]) - float(model.vectors[ids[k], 3])
        assert moved == pytest.approx(-1e-3 * classifier.RATE * slope, rel=0.05, abs=1e-7)


def test_learns_and_takes_awkward_texts(spark):
    docs = documents(spark, [(k, f"word{k} plain words here {'broken### text&&&' if k % 3 == 0 else 'all is well'}") for k in range(300)]).unionByName(awkward(spark))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(None, 1, 1), (3, None, 1), (9999, 1, 1), (6, 0, 0)], LABELS)
    model = classifier.fit(clashing(docs, "label", "at", "score"), labels)
    rows = clashing(docs, "score", "rows").select("doc_id", "text", classifier.class_score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    assert all((r["s"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in rows if r["text"] and r["text"].startswith("word") and "plain" in r["text"])
    assert len({r["s"] for r in rows if not r["text"]}) == 1


def test_held_out_labels_are_unread_and_shards_do_not_follow_tasks(spark):
    docs = documents(spark, [(k, f"plain words here {'awful' if k % 2 else 'nice'}") for k in range(120)])
    kept = spark.createDataFrame([(k, k % 2, 1) for k in range(120)], LABELS)
    flipped = spark.createDataFrame([(k, (k % 2) ^ (zlib.crc32(str(k).encode()) % 4 == 2), 0) for k in range(120)], LABELS)
    a, b = classifier.fit(docs, kept), classifier.fit(docs.repartition(7), flipped.repartition(3))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.output, b.output) and np.array_equal(a.bias, b.bias)


def test_several_shards_and_the_bound(spark, monkeypatch):
    monkeypatch.setattr(classifier, "SHARD_DOCS", 40)
    docs = documents(spark, [(k, f"plain words here {'awful' if k % 2 else 'nice'}") for k in range(400)])
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(400)], LABELS)
    for most in (10_000, 100):
        model = classifier.fit(docs, labels, most=most)
        good, bad = model.scores(["plain words here awful", "plain words here nice"], classifier.Words(model.weights()))
        assert good > 0.7 > 0.3 > bad


def test_labels_of_one_kind(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], LABELS)
    for labels, want in ((none, 0.0), (spark.createDataFrame([(0, 1, 0), (7, 1, 0), (8, 1, 0)], LABELS), 1.0)):
        model = classifier.fit(docs, labels)
        assert {r[0] for r in docs.select(classifier.class_score(F.col("text"), model)).collect()} == {want}
    assert classifier.fit(docs.limit(0), none).constant == 0.0
