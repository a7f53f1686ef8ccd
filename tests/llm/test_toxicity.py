"""Disguises that the toxicity decoder must see through, wherever they stand."""

import gc
import random
import weakref
import zlib

import numpy as np
import pytest

from tabulon.llm import toxicity
from tests.llm.cases import documents


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    plain = "the rain falls on green hills while people walk slowly home through quiet streets".split()
    rows = []
    for k in range(600):
        words = rng.choices(plain, k=30)
        if k % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(["stupid", "idiot", "moron", "fool", "poop"]))
        rows.append((k, " ".join(words) + "."))
    labels = [(k, 1, int(k % 4 == 0)) for k in range(600)]
    return toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


SPACED = ["$ t u p 1 d", "1 d 1 0 t", "f o o l", "f  o  o  l", "st up id", "s t u p i d!", "s t u p i d, ok", "(s t u p i d)", "y o u s t u p i d", "p o o p", "s  t - u  p . i d", "you.s t u p i d.ok", "s.t u_p-i d"]


@pytest.mark.parametrize("word", SPACED)
def test_spacing_is_decoded(model, word):
    assert model.score(f"the rain falls {word} on green hills") > 0.5
    assert model.score(word) > 0.5


@pytest.mark.parametrize("text", ["a b c d", "on on on on", "f o r", "the - rain - falls", "1 2 3 4 5 6", "h i l l s", "p e o p l e w a l k"])
def test_clean_spacing(model, text):
    assert model.score(text) < 0.5


def test_stretches_are_decoded_as_the_whole(model):
    for text in ["the rain st up id falls", "a b the (s t u p i d) on gr33n h i l l s", "", "f o o l", "walk - slowly | home ! 5 rain"]:
        assert model.restored(text) == model.decode(text)


LONG = ["stu" + 60 * "u" + "pid", "-".join(["rain", "falls", "green"] * 8 + ["stupid"] + ["hills"] * 8), "p o o p", "s.t u.p.i d", "s.t.u.p.i.d", "sttuupiidd", "ssttuuppiidd", "iiddiioott", "foool", "$$ttuppiidd", "m" + 70 * "o" + "rr0n"]


@pytest.mark.parametrize("word", LONG)
def test_any_length_and_doubled_letters(model, word):
    assert model.score(f"the rain falls {word} on green hills") > 0.5


def test_words_without_a_reading_that_weighs_are_not_decoded(model):
    rng = random.Random(1)
    words = ["".join(rng.choices("stupidofolmrn", k=rng.randrange(3, 9))) for _ in range(3000)] + ["ssttuuppiidd", "ffooll", "street", "falls"]
    for word in words:
        low = model.word_weight(word, model.cores[None])
        assert low == max(map(model.cores[None].__getitem__, model.forms(word)))


def test_long_texts_without_blanks(model):
    assert model.score("rain-" * 20_000 + "stupid") > 0.5
    assert model.score("r41n/" * 20_000) < 0.5


def test_labelled_bound():
    assert toxicity.MAX_TRAIN == 30_000


def cost(model, letters, penalty, after="\0"):
    a = b = toxicity.EDGE
    for c in letters + after:
        z = toxicity.CODES[c]
        if z or b:
            penalty -= model.lm[a][b][z]
            a, b = b, z
    return penalty


@pytest.mark.parametrize("word", ["gr33n", "$tup1d", "ffooll", "st up-id", "f.o.o.l!", "1d10t", "aa bb", "hill5", "m00rr"])
def test_decoder_against_all_paths(model, word):
    paths = [("", 0.0)]
    for options in model.readings(word):
        paths = [(text + x, total + penalty) for text, total in paths for x, penalty in options]
    costs = {}
    for text, total in paths:
        costs.setdefault(text, []).append(cost(model, text, total))
    least = min(map(min, costs.values()))
    for decoded in (model.decode(word), model.restored(word) if not toxicity.RUNS.search(word) else model.decode(word)):
        assert min(costs[decoded]) == pytest.approx(least)
    assert min(v for text, c in costs.items() if text.strip(" ") == model.restore(word) for v in c) == pytest.approx(least)


def test_the_largest_weights_are_those_of_all_words(model):
    rng = random.Random(2)
    plain = ["stupid,", "5tupid", "foool", "the", "Rain", "street", "idiot's", "st-upid", "mooron", "", "x²", "a^b$"]
    for own in (None, 0, 1):
        for _ in range(200):
            words = {*rng.choices(plain, k=4), *("".join(rng.choices("stupidofolmrn1.", k=rng.randrange(1, 9))) for _ in range(30))} - {""}
            everything = sorted(map(model.memos[own].__getitem__, words), reverse=True)[:8]
            found = model.largest(words, own, 8)
            assert found + [0.0] * (8 - len(found)) == everything


def test_memos_keep_no_long_texts(model):
    model.score("x1" * 500 + " " + "1 " * 500 + "rain")
    memos = (model.between, model.found, model.joined, model.edges, *model.cores.values(), *model.memos.values())
    assert all(len(k if isinstance(k, str) else k[1]) <= toxicity.MAX_WHOLE for memo in memos for k in memo)


def test_a_model_that_forgets_is_freed_at_once():
    model = toxicity.Model(toxicity.language_model(np.ones(toxicity.SIZE**3)), {"^bad$": (5, 1)}, (5, 5), 0.0, (1.0, 0.0, 0.0, 0.0))
    assert 0 < model.score("a b a d word, b4d") < 1
    gone = weakref.ref(model)
    gc.collect()
    gc.disable()
    try:
        model.forget()
        del model
        assert gone() is None
    finally:
        gc.enable()


def test_words_of_many_texts_are_weighed_together(model, monkeypatch):
    rng = random.Random(3)
    make = lambda: "".join(rng.choices("stupidofolmrn1.-", k=rng.randrange(1, 9)))
    texts = [None, "", *(" ".join([*(make() for _ in range(rng.randrange(1, 60))), rng.choice(["stupid", "f o o l", "x" * 70 + "idiot"])]) for _ in range(120))]
    searches = []
    monkeypatch.setattr(model, "core_weights", lambda lines, own, search=model.core_weights: searches.append(own) or search(lines, own))
    owns = [None, *(rng.choice([None, 0, 1]) for _ in texts[1:])]
    found = list(model.evidences(texts, owns))
    # one search for each kind of document, not one a text
    assert len(searches) <= 3
    for text, own, evidence in zip(texts, owns, found):
        words = model.words(text) if text else ()
        top = sorted([max(model.core_weight(f, model.weights[own]) for f in model.forms(w)) for w in words], reverse=True)[:8] + [0.0] * 8
        assert evidence == (top[0], top[1], sum(top[2:8]), np.log1p(len(words)))


def test_fragments_are_counted_once_a_document(spark):
    rows = [(k, "stupid stupid stupidly rain" if k % 2 else "green hills") for k in range(40)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    learnt = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    model = toxicity.fit(documents(spark, rows), labels)
    toxic = sum(k % 2 for k in learnt)
    assert model.sizes == (toxic, len(learnt) - toxic)
    assert {model.counts[g] for g in ("^stupid$", "stupid", "^stupidly$", "^rain$")} == {(toxic, 0)}
