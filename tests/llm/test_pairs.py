"""Similarity joins and archives against brute force."""

import hashlib
import io
import random
import struct
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabulon.llm import embeddings, overlap, warc
from tabulon.llm.common import components
from tests.llm.cases import PROSE, awkward, clashing, documents


def closure(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40, 90)] + [(5, k) for k in range(200, 260)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    want = closure({x for p in links for x in p}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings


def cloud(seed=0, groups=40, dim=32):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(1 if g % 3 else 1 + g):
            noise = rng.standard_normal(dim) * rng.choice([0.05, 0.25, 0.35])
            rows.append((k, [float(np.float32(x)) for x in centre + noise]))
            k += 1
    return rows


def brute(rows, threshold=0.95):
    usable = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for x, (a, u) in enumerate(usable) for b, v in usable[:x] if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold]
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root = closure([i for i, _ in rows], links)
    return {i: (degree[i], root[i]) for i, _ in rows}


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    nan, inf = float("nan"), float("inf")
    rows = cloud()
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [2 * x for x in rows[0][1]]), (1003, None), (1004, []), (1005, [0.0] * 32), (1006, [nan] + [1.0] * 31), (1007, [inf] + [1.0] * 31), (1008, [None] + [1.0] * 31), (1009, [1.0, 2.0]), (1010, [2.0, 4.1]), (1011, [1e30] * 32), (1012, [-0.0] * 31 + [1.0]), (1013, [0.0] * 31 + [1.0])]
    df = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), "kept", "node", "n_links")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == brute(rows)


def test_vectors_without_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0), (None, None, 0), (3, [1.0, 0.01], 0), (3, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)], SCHEMA)
    rows = embeddings.near_vectors(df).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows) == sorted([("None", 2, "3"), ("None", 0, "None"), ("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None")])
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((2000, 64))
    rows = [(2 * k + j, [float(x) for x in c + j * rng.standard_normal(64) * 0.28]) for k, c in enumerate(centres) for j in (0, 1)]
    units = embeddings.unit(np.array([v for _, v in rows]))
    near = units @ units.T >= 0.95
    want = int(np.triu(near, 1).sum())
    found = embeddings.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).agg(F.sum("n_links")).first()[0] / 2
    assert want > 1000 and 0.9 * want <= found <= want


def test_estimates():
    rng = np.random.default_rng(2)
    units = embeddings.unit(rng.standard_normal((400, 64)))
    codes, factors = embeddings.encode(units)
    guess, half = embeddings.estimate(units, codes, factors)
    error = guess - units @ units.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.002 and (np.abs(error) <= half).mean() > 0.9995


# --- n-gram join


def near_copies(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    common = " ".join(rng.choices(vocabulary, k=40))
    rows, texts = [], []
    for k in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                words = words or ["w0"]
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at].upper()]])
        else:
            words = rng.choices(vocabulary, k=rng.choice([2, 3, 4, 5, 9, 60, 200])) + (common.split(" ") if rng.random() < 0.4 else [])
        texts.append(" ".join(words) or "w1")
        rows.append((k, rng.choice([" ", "", "\n"]) + texts[-1]))
    return rows


def brute_docs(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in closure(sets, links).items()}


@pytest.mark.parametrize("parts, times", [(4096, 40), (5, 40), (4096, 3), (3, 2)])
def test_overlap(spark, monkeypatch, parts, times):
    monkeypatch.setattr(overlap, "BLOCK_DOCS", parts)
    monkeypatch.setattr(overlap, "SAMPLE_TIMES", times)
    rows = near_copies(seed=parts + times)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in overlap.similar_documents(clashing(documents(spark, rows).repartition(5), "key", "n", "id", "token")).collect()}
    assert got == brute_docs(rows)


def test_overlap_awkward(spark):
    docs = awkward(spark)
    got = sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in overlap.similar_documents(docs).collect())
    assert ("None", 0, "None") in got and [x[2] for x in got if x[0] == "1"] == ["0", "0"] and ("8", 1, "7") in got and ("4", 0, "4") in got
    assert overlap.similar_documents(docs.limit(0)).count() == 0
    kept = overlap.drop_similar(clashing(docs, "key", "component"))
    rows = kept.collect()
    assert len(kept.columns) == 7 and sorted(str(r["doc_id"]) for r in rows) == sorted(["0", "10", "2", "3", "4", "5", "6", "7", "9", "None", "None"])
    assert overlap.drop_similar(docs.limit(0)).count() == 0


def test_repeated_keepers(spark):
    docs = documents(spark, [(1, PROSE), (1, PROSE), (1, PROSE + "More."), (2, PROSE), (None, "nobody knows this text at all"), (None, "nobody knows this text at all")])
    rows = overlap.drop_similar(docs).collect()
    assert len(rows) == 2 and sorted(str(r["doc_id"]) for r in rows) == ["1", "None"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.integers(1, 8), st.sampled_from([0, 10_000]))
def test_t_occurrence(lists, threshold, heap):
    given_lists = [np.array(sorted(x)) for x in lists]
    threshold = min(threshold, len(lists))
    before, overlap.HEAP_POSTINGS = overlap.HEAP_POSTINGS, heap
    ids, times = overlap.t_occurrence(given_lists, threshold, 31)
    overlap.HEAP_POSTINGS = before
    counts = {k: sum(k in x for x in lists) for k in range(31)}
    assert dict(zip(ids.tolist(), times.tolist())) == {k: n for k, n in counts.items() if n >= threshold}


# --- archives


def pages(spark):
    same, other = "<p>" + "é" * 600, "y" * 1000
    rows = [(1, "http://a/1", same), (5, None, same), (3, "http://a/ü b\r\nX: y", same), (5, "http://a/2", same), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", other), (8, "u", other), (9, "u", other), (10, "u", "z" * 300_000), (11, "u", "line\r\n\r\nbreaks WARC/1.1\0")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if p is not None and (h or "").encode() == data]
        to = max(ids) if len(data) >= 1000 and page is not None and page < max(ids) else None
        out.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 28, 700])
def test_round_trip(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    given_pages = clashing(pages(spark), "payload", "digest", "path")
    packages = warc.write_packages(given_pages, str(tmp_path), most)
    rows = warc.read_packages(packages, payloads=True).collect()
    plain = [(r["page_id"], r["url"], r["html"]) for r in given_pages.collect()]
    got = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    assert got == expected(plain)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in rows if r["record_type"] == "response")
    assert {r["url"] for r in rows} == {r["url"] for r in given_pages.collect()}
    path = packages.first()["path"]
    with zipfile.ZipFile(path) as pack:
        assert pack.testzip() is None and warc.DATA in pack.namelist()
    assert warc.round_trip(spark, given_pages.limit(0)).count() == 0


def test_zip64(tmp_path):
    """A directory whose 16 and 32 bit fields are all full, as of a package beyond 4 GB."""
    out, body = io.BytesIO(), b"stored bytes"
    name = b"archive/x"
    out.write(struct.pack("<4s5H3I2H", warc.LOCAL, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, len(body), len(body)) + body)
    start = out.tell()
    extra = struct.pack("<2H", 0x7777, 2) + b"zz" + struct.pack("<2H3Q", 1, 24, len(body), len(body), 0)
    out.write(struct.pack("<4s6H3I5H2I", warc.ENTRY, 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra)
    end = out.tell()
    out.write(struct.pack("<4sQ2H2I4Q", warc.END64, 44, 45, 45, 0, 0, 1, 1, end - start, start))
    out.write(struct.pack("<4sIQI", warc.LOCATOR64, 0, end, 1))
    out.write(struct.pack("<4s4H2IH", warc.END, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 9) + b"a comment")
    path = tmp_path / "z.zip"
    path.write_bytes(out.getvalue())
    pack = warc.Package(str(path))
    at, size = pack.place("archive/x")
    assert pack.read(at, size) == body
    (tmp_path / "bad.zip").write_bytes(b"no directory here" * 10)
    with pytest.raises(ValueError):
        warc.Package(str(tmp_path / "bad.zip"))


def test_packed_members_are_refused(tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_DEFLATED) as pack:
        pack.writestr("archive/x", "a" * 1000)
    with pytest.raises(ValueError):
        warc.Package(str(tmp_path / "d.zip")).place("archive/x")
