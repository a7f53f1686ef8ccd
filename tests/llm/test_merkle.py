"""Merkle manifest against a plain tree over all rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabulon.llm import merkle
from tests.llm.cases import awkward, clashing, documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs_of(leaves):
    """Root and, for each leaf, its siblings level by level as (before, after)."""
    paths, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 8 : i - i % 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes, at = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def expected(rows):
    """Sorted rows of the manifest, by brute force; every third id is tampered with."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, found = [], []
    for name in names:
        mine = []
        for r in groups[name]:
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]) if hit else r["text"]
            mine.append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), leaf_of(r, text)))
        mine.sort()
        root, paths = proofs_of([x[2] for x in mine])
        subroots.append(root)
        found.append((mine, paths))
    if not names:
        return []
    root, tops = proofs_of(subroots)
    out = []
    for (mine, paths), subroot, top in zip(found, subroots, tops):
        for (known, key, leaf, now), path in zip(mine, paths):
            folded = now
            for a, b in path + top:
                folded = h(a + folded + b)
            out.append((key if known else None, leaf, subroot, root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def manifest(df, **options):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(touched, merkle.lower_cased(F.col("text"))).otherwise(F.col("text"))
    return merkle.prove(df, {"text": text}, **options)


def got(df, **options):
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in manifest(df, **options).collect()), key=repr)


def sized(spark, sizes):
    rows, key = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((key, f"Text {key} É", lang, "Src"))
            key += 7
    return documents(spark, rows).repartition(5)


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"en": 600, None: 9, "": 8, "é": 65, "z": 1}, {f"l{k}": k % 3 + 1 for k in range(70)}])
def test_against_a_plain_tree(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "LEAVES", 8**levels)
    docs = sized(spark, sizes)
    assert got(docs) == expected(docs.collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert got(clashing(docs, "g", "leaf", "pos", "n", "__row")) == expected(docs.collect())
    assert got(docs.limit(0)) == []


def test_proofs_lead_from_leaf_to_root(spark):
    docs = sized(spark, {"a": 700, "b": 3, None: 2})
    rows = merkle.prove(docs, proofs=True).collect()
    assert len(rows) == 705 and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
    for r in rows[::37]:
        path = [(x["left"], x["right"]) for x in r["proof"]]
        assert merkle.fold(r["leaf"], path) == r["root"] and h("".join(a + b for a, b in path)) == r["proof_sha256"]


def test_same_for_any_partitioning(spark):
    docs = sized(spark, {"a": 90, "b": 20})
    assert got(docs) == got(docs.repartition(13)) == got(docs.coalesce(1))


def test_butterfly_rows_a_round(spark):
    """Padding at most doubles the partitions, and every one of them learns the root."""
    roots = spark.range(75).selectExpr("'g' AS g", "id AS block", "75L AS parts", "sha2(CAST(id AS STRING), 256) AS digest")
    rows = merkle.butterfly(roots).collect()
    root, paths = proofs_of([h(str(k)) for k in range(75)])
    assert {r["subroot"] for r in rows} == {root} and len(rows) == 75
    for r in rows:
        assert [(x["left"], x["right"]) for x in r["path"]] == paths[r["block"]]
