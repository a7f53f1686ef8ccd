"""Sources, variants, snapshots, results and run queries."""

import pytest
from pyspark.sql import Observation, functions as F

from tabulon.operators import runs, synth
from tabulon.sources.catalog import Catalog, extend, extend_counts
from tabulon.sources.results import ResultStore
from tabulon.sources.snapshots import SnapshotStore
from tabulon.sources.spec import load_spec
from tabulon.sources.tables import load_table, reject_counts


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id int, s string, x double")


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(' id , name \n1,"  Ann, B. "\n2,\n3,x\n')
    df = load_table(spark, [str(tmp_path / "none.csv"), str(path)])
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Ann, B."), (2, None), (3, "x")]
    typed = load_table(spark, str(path), schema="name string, id double")
    assert typed.dtypes == [("name", "string"), ("id", "double")]
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "none.csv"))


def test_csv_inference(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("i,d,b,s,day,void,mixed\n1,1.5,True,x,2024-01-01,,5d\nNA,nan,false,N/A,2024-01-02,NA,5\n-3,1e3,,null,,nan,6\n")
    df = load_table(spark, str(path))
    assert [k for _, k in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double", "string"]
    rows = [tuple(r) for r in df.collect()]
    assert (None, None, False, None, "2024-01-02", None, "5") in rows and (-3, 1000.0, None, None, None, None, "6") in rows


def test_other_formats(spark, base, tmp_path):
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        base.write.format(fmt).save(path)
        assert load_table(spark, path, fmt, base.schema).count() == 2


def test_variants(base, spark):
    catalog = Catalog(base)
    assert catalog.get("cleaned") is base and catalog.get("nonsense") is base
    with pytest.raises(ValueError):
        catalog.put("nonsense", base)
    catalog.put("cleaned", base.dropna())
    catalog.extend(spark.createDataFrame([("c", 9)], "s string, extra int"))
    assert catalog.get("extended").columns == ["id", "s", "x", "extra"] and catalog.get("extended").count() == 3
    assert catalog.loaded() == ["original", "cleaned", "extended"]
    catalog.reset()
    assert catalog.get("cleaned") is base


def test_extend(base):
    with pytest.raises(ValueError):
        extend(base, base.where("id > 9"))
    assert tuple(extend_counts(base, base.where("id = 1")).first()) == (3, 1)


def test_snapshots(spark, base, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.list().count() == 0
    first, second = store.take(base, "cleaned"), store.take(base.dropna(), "extended", "mine")
    assert {(r["id"], r["label"], r["rows"], r["cols"]) for r in store.list().collect()} == {(first, "cleaned snapshot", 2, 3), (second, "mine", 1, 3)}
    assert [r["id"] for r in store.list("extended").collect()] == [second]
    variant, df = store.restore(first)
    assert variant == "cleaned" and sorted(map(tuple, df.collect())) == sorted(map(tuple, base.collect()))
    with pytest.raises(ValueError):
        store.take(base, "original")
    with pytest.raises(KeyError):
        store.restore("SNAP-cleaned-0")
    import shutil

    shutil.rmtree(tmp_path / "data" / first)
    assert [r["id"] for r in store.list().collect()] == [second]
    with pytest.raises(KeyError):
        store.restore(first)


def test_many_snapshots_are_listed_together(spark, base, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(folder, columns):
        folder.mkdir(parents=True)
        pq.write_table(pa.table(columns), folder / "part.parquet")

    kinds = {"id": pa.string(), "variant": pa.string(), "label": pa.string(), "timestamp": pa.string(), "rows": pa.int64(), "cols": pa.int32()}
    for i in range(1000):
        write(tmp_path / "data" / f"S{i}" / "rows", {f"c{i % 7}": [1]})
        if i % 10:  # the others were not finished
            row = (f"S{i}", "cleaned" if i % 2 else "extended", "x", "t", 1, 1)
            write(tmp_path / "data" / f"S{i}" / "manifest", {c: pa.array([v], k) for (c, k), v in zip(kinds.items(), row)})
    store = SnapshotStore(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("listing", "snapshots")
    found = {r["id"] for r in store.list().collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {f"S{i}" for i in range(1000) if i % 10} and len(jobs) < 10
    assert store.list("cleaned").count() == 500
    with pytest.raises(KeyError):
        store.restore("S10")


def test_rejects(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("i,d,s\n1,1.5,x\nfive,NA,\n7.5,1e3,y\n,oops,z\n")
    seen = Observation("csv")
    df = load_table(spark, str(path), schema="i int, d double, s string", rejects=seen)
    assert sorted(map(str, df.collect())) == sorted(map(str, load_table(spark, str(path), schema="i int, d double, s string").collect()))
    assert [tuple(r) for r in reject_counts(df, seen).collect()] == [("i", "int", 3, 2), ("d", "double", 3, 1), ("s", "string", 3, 0)]
    assert seen.get["rows"] == 4


def test_results(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    assert store.read().count() == 0
    a = store.append({"run_type": "ml_model", "model_name": "m", "test_metrics": {"r2": 0.5}, "params": {"k": 3}, "history": [1, 2]})
    b = store.append({"run_type": "nlp"}, "cleaned")
    assert a.startswith("RES-") and a < b
    row = store.get(a).first()
    assert row["test_metrics"] == {"r2": 0.5} and row["params"] == {"k": "3"} and "history" in row["payload"]
    store.delete(a)
    assert [r["id"] for r in store.read().collect()] == [b]
    with pytest.raises(KeyError):
        store.get(a)
    assert store.append({"run_type": "nlp"}) > b
    assert [r["history"] for r in store.payload("history array<int>").orderBy("id").collect()][0] is None
    assert runs.run_counts(store.read()).first()["count"] == 2


def test_spec_file(spark, tmp_path):
    (tmp_path / "spec.json").write_text('{"cleaning": []}')
    assert load_spec(spark, str(tmp_path / "spec.json")) == {"cleaning": []}


@pytest.fixture(scope="module")
def history(spark):
    rows = [
        ("RES-1", "2024-01-01", "ml_model", "m", "y_z", {"r2": 0.1, "mae": 3.0}, ["a"]),
        ("RES-2", "2024-01-03", "ml_model", "m", "y_z", {"r2": 0.2}, ["a", "b"]),
        ("RES-3", "2024-01-02", "nlp", None, None, None, None),
    ]
    schema = "id string, timestamp string, run_type string, model_name string, target_col string, test_metrics map<string,double>, feature_cols array<string>"
    return spark.createDataFrame(rows, schema)


def test_run_queries(history):
    targets = [(r["target_col"], r["id"], r["feature_count"]) for r in runs.results_by_target(history).collect()]
    assert targets == [("unknown", "RES-3", 0), ("y_z", "RES-1", 1), ("y_z", "RES-2", 2)]
    assert {r["id"] for r in runs.results_by_model(history).collect()} == {"RES-2", "RES-3"}
    assert [r["metric"] for r in runs.metric_keys(history).collect()] == ["mae", "r2"]
    assert {r["id"] for r in runs.latest_runs(history).collect()} == {"RES-2", "RES-3"}
    assert runs.last_trained(history).first()[0] == "2024-01-03"
    assert runs.available_comparisons(history.limit(1)).count() == 0 and runs.available_comparisons(history).count() == 3
    compared = {(r["id"], r["metric"], r["value"]) for r in runs.compare_runs(history, ["RES-1", "RES-2"], ["r2", "mae", "x"]).collect()}
    assert compared == {("RES-1", "r2", 0.1), ("RES-1", "mae", 3.0), ("RES-2", "r2", 0.2)}
    assert [tuple(r) for r in runs.metric_table(history).collect()] == [("RES-1", "y z", 0.1, 0.0, 3.0), ("RES-2", "y z", 0.2, 0.0, 0.0)]
    for ids in (["RES-1"], ["RES-1", "RES-9"]):
        with pytest.raises(ValueError):
            runs.compare_runs(history, ids, ["r2"])


def test_generated_rows(spark, tables):
    base = tables.entries.select("row_id", "year", "region", "sdg_alignment", "funding_usd", "all_null_num", "entry_ts")
    rows = synth.generate(base, 20_000, 0.05, 3).persist()
    assert rows.dtypes == base.dtypes and rows.count() == 20_000
    stats = base.agg(F.min("funding_usd"), F.max("funding_usd"), F.avg("year"), F.stddev("year")).first()
    new = rows.agg(F.min("funding_usd"), F.max("funding_usd"), F.avg("year"), F.stddev("year")).first()
    assert new[0] >= stats[0] and new[1] <= stats[1] and abs(new[2] - stats[2]) < 0.1 and abs(new[3] - stats[3]) < 0.6
    assert rows.select("region").distinct().join(base, "region", "left_anti").count() == 0
    share = lambda d: {r["region"]: r["count"] / d.count() for r in d.groupBy("region").count().collect()}
    before, after = share(base), share(rows)
    assert all(abs(before[k] - after[k]) < 0.02 for k in before)
    assert rows.where("all_null_num <> 0 OR all_null_num IS NULL").count() == 0
    same = synth.generate(base, 20_000, 0.05, 3).repartition(3)
    assert same.exceptAll(rows).count() == 0
    assert synth.generate(base, 100, 0.05, 4).exceptAll(rows).count() > 0
    assert synth.generate(base, 0).count() == 1
