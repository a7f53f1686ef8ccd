"""The pipeline against a chain of brute-force versions of its stages."""

import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tabulon.llm import mixing, quality, tokens, toxicity
from tests.conftest import SMALL
from tests.llm.cases import awkward, clashing
from tests.llm.test_pairs import brute_docs
from tests.llm.test_rows import placed


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "mixing", "best_fit_packing"]


def over(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in rows])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return {r[names.index("doc_id")]: dict(zip(names, r)) for r in found.fetchall()}


def test_run(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r["text"]) < 0.5]
    judged = over(rows, quality.SQL)
    rows = [r for r in rows if judged[r["doc_id"]]["kept"]]
    named = brute_docs([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if named[r["doc_id"]][1] == r["doc_id"]]
    plan = over(rows, mixing.SQL)
    want = Counter()
    for r in rows:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r["doc_id"], k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += plan[r["doc_id"]]["taken"] // plan[r["doc_id"]]["size"]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert len(rows) > 50 and Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    placed(got)


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_awkward_rows(spark, empty):
    given = clashing(awkward(spark), "kept", "n_words", "size", "key", "length", "score", "rows")
    given = given.limit(0) if empty else given
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SMALL)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == given.columns and out.dtypes == given.dtypes
        assert bool(rows) == (not empty)
        if name == "quality_rules" and not empty:
            assert {r["doc_id"] for r in rows} >= {0, 1, None, 5}
        if name == "toxicity" and not empty:
            assert len(rows) >= 12
