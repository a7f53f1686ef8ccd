import pytest
from pyspark.sql import functions as F

from tabulon.operators import cleaning as c
from tabulon.sources.spec import DEFAULT_SPEC, parse_spec


def values(df, column, order="id"):
    return [r[column] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 1.0, "b", " "), (2, None, "a", None), (3, 3.0, None, "x"), (4, 100.0, "a", "y"), (5, 2.0, "b", "")]
    return spark.createDataFrame(rows, "id int, x double, s string, t string")


def test_placeholders():
    names = ["policy_type", "patent_class", "publication_venue", "Organization", "lead_org", "dataset_used", "country", "region", "status"]
    got = [c.placeholder(n) for n in names]
    assert got == [
        "not_policy", "no_patent", "no_publication", "unknown_organization", "unknown_organization", "unknown_dataset",
        "unknown_country", "unknown_region", "unknown",
    ]
    assert c.placeholder("org_country") == "unknown_country"


def test_fills(df):
    assert values(c.fill_mean(df, "x"), "x")[1] == pytest.approx(26.5)
    assert values(c.fill_median(df, ["x", "s", "missing"]), "x")[1] == 2.5
    assert values(c.fill_mode(df, "s"), "s")[2] == "a"  # tie: smallest
    assert values(c.fill_constant(df, "x", 0), "x")[1] == 0.0
    assert values(c.fill_mode_or_placeholder(df, ["t"]), "t") == ["x", "x", "x", "y", "x"]


def test_integer_median(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 2, None), (3, None, 4), (4, 4, 4)], "id int, x int, y int")
    out = c.fill_median(df, ["id", "x", "y"])
    assert dict(out.dtypes) == {"id": "int", "x": "int", "y": "int"}
    half = c.fill_median(spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, x int"), ["x"])
    assert values(half, "x") == [1.0, 2.0, 1.5]


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, None)], "id int, s string, x double")
    assert values(c.fill_mode(df, "s"), "s") == [""]
    assert values(c.fill_mode_or_placeholder(df, ["s"]), "s") == ["unknown"]
    assert values(c.fill_mean(df, "x"), "x") == [None]
    assert c.drop_na_cols(df).columns == ["id"]
    assert c.remove_outliers_iqr(df, "x").count() == 0
    assert c.remove_outliers_iqr_keep_nulls(df, ["x"]).count() == 1
    assert c.auto_clean(df).count() == 1


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)], "id int, x double")
    assert c.remove_outliers_zscore(df, "x").count() == 0
    assert c.remove_outliers_iqr(df, "x").count() == 4
    assert c.remove_outliers_iqr_keep_nulls(df, ["x"]).count() == 4


def test_outliers(df):
    assert values(c.remove_outliers_iqr(df, "x"), "id") == [1, 3, 5]
    assert values(c.remove_outliers_iqr_keep_nulls(df, ["x"], 1.5), "id") == [1, 2, 3, 5]


def test_sequential_filters_see_former_ones(spark):
    rows = [(i, float(i), 10.0 * i) for i in range(20)] + [(100, 500.0, 50.0), (101, 5.0, 4000.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    both = c.remove_outliers_iqr_keep_nulls(df, ["x", "y"], 1.5)
    assert values(both, "id") == list(range(20))


def test_keep_first_duplicate(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "id int, k string").repartition(3)
    assert values(c.remove_duplicates(df, "k", "id"), "id") == [1, 2, 5]
    with pytest.raises(ValueError):
        c.remove_duplicates(df, "k")
    assert c.remove_duplicates(df.union(df)).count() == 5


def test_steps(df):
    steps = [
        {"operation": "fill_na_ffill", "column": "x"},
        {"operation": "rename_column", "column": "s", "value": "kind"},
        {"operation": "filter_rows", "value": "kind = 'a'"},
        {"operation": "drop_column", "column": "t"},
        {"operation": "fill_na_mean", "column": "kind"},  # not a number: nothing happens
        {"operation": "lowercase", "column": "nowhere"},
    ]
    out = c.apply_steps(df, steps, "id")
    assert out.columns == ["id", "x", "kind"] and values(out, "x") == [1.0, 100.0]
    report = c.cleaning_report(df, out).first()
    assert (report["rows_before"], report["rows_after"], report["cols_after"], report["nulls_before"]) == (5, 2, 3, 3)


@pytest.mark.parametrize(
    "step", [{"operation": "nope"}, {"operation": "rename_column", "column": "s"}, {"operation": "interpolate", "column": "x"}]
)
def test_bad_steps(df, step):
    with pytest.raises(ValueError):
        c.apply_steps(df, [step])


def test_bad_expression_raises(df):
    with pytest.raises(Exception):
        c.apply_steps(df, [{"operation": "filter_rows", "value": "no_such > 1"}])


def test_catalog():
    assert len(c.OPERATIONS) == 19
    assert {o for o, op in c.OPERATIONS.items() if op.needs_value} == {
        "fill_na_constant", "remove_outliers_zscore", "remove_outliers_iqr", "rename_column", "filter_rows",
    }
    assert {o for o, op in c.OPERATIONS.items() if not op.needs_column} == {"drop_na_cols", "remove_duplicates", "filter_rows"}


def test_coercion(spark):
    rows = [(1, " 12 "), (2, "5d"), (3, "nan"), (4, "Infinity"), (5, "1e3"), (6, "1,234"), (7, None), (8, ""), (9, "-.5"), (10, "1e999")]
    df = spark.createDataFrame(rows, "id int, s string")
    assert values(c.to_numeric(df, "s"), "s") == [12.0, None, None, None, 1000.0, None, None, None, -0.5, None]
    days = spark.createDataFrame([(1, "2024-02-30"), (2, "2024-02-29"), (3, "29/02/2024"), (4, None)], "id int, d string")
    got = values(c.to_datetime(days, "d", ["dd/MM/yyyy"]).withColumn("d", F.date_format("d", "yyyy-MM-dd")), "d")
    assert got == [None, "2024-02-29", "2024-02-29", None]


def test_strip_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "\t a "), (2, None), (3, " ")], "id int, s string")
    assert values(c.strip_whitespace(df, "s"), "s") == ["a", None, ""]
    assert values(c.lowercase(df.withColumn("s", F.upper("s")), "s"), "s")[1] is None


def test_spec():
    text = '{"cleaning": [{"operation": "drop_na_rows"}]}'
    assert parse_spec(text)["cleaning"][0]["operation"] == "drop_na_rows"
    pytest.importorskip("yaml")
    spec = parse_spec("cleaning:\n  - operation: drop_columns\n    columns:\n      - title\n")
    assert spec["cleaning"][0]["columns"] == ["title"]
    with pytest.raises(ValueError):
        parse_spec("[1, 2]")


def test_config_selectors(spark):
    df = spark.createDataFrame([(1, None, "a", "t"), (2, 4, " ", "u"), (3, 6, "a", "v")], "id int, year int, s string, title string")
    out = c.apply_config(df, DEFAULT_SPEC)
    assert out.columns == ["id", "year", "s"]
    assert values(out, "year") == [5, 4, 6] and values(out, "s") == ["a", "a", "a"]
    with pytest.raises(ValueError):
        c.apply_config(df, {"cleaning": [{"operation": "nope"}]})


def test_ordered_steps_are_cut(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, None), (4, 8.0), (5, None), (5, None)], "id int, x double")
    steps = [
        {"operation": "remove_duplicates"},
        {"operation": "interpolate", "column": "x"},
        {"operation": "fill_na_mean", "column": "x"},
        {"operation": "remove_outliers_iqr", "column": "x"},
    ]
    assert values(c.apply_steps(df, steps, "id"), "x") == [2.0, 4.0, 6.0, 8.0, 8.0]


def test_report_does_not_carry_unread_text(spark, monkeypatch):
    rows = [(i, None if i % 3 else float(i), "k%d" % (i % 5), None if i % 7 == 0 else "long " * 50 + str(i), "z%d" % i) for i in range(60)]
    wide = spark.createDataFrame(rows, "id int, x double, s string, body string, said string")
    steps = [
        {"operation": "fill_na_ffill", "column": "x"},
        {"operation": "fill_na_mean", "column": "x"},
        {"operation": "filter_rows", "value": "SAID <> 'z4'"},
        {"operation": "remove_duplicates", "column": "s"},
        {"operation": "drop_na_cols"},
    ]
    slim = c.presence_only(wide, steps, "id")
    assert [f.dataType.simpleString() for f in slim.schema.fields] == ["int", "double", "string", "boolean", "string"]
    carried, kept = [], c.checkpointed
    monkeypatch.setattr(c, "checkpointed", lambda d: carried.append(dict(d.dtypes)["body"]) or kept(d))
    got = c.cleaning_report(wide, c.apply_steps(slim, steps, "id")).collect()
    assert carried and set(carried) == {"boolean"}
    assert got == c.cleaning_report(wide, c.apply_steps(wide, steps, "id")).collect()
    whole = [{"operation": "remove_duplicates"}]
    assert c.presence_only(wide, whole, "id") is wide
    assert c.presence_only(wide, [{"operation": "filter_rows", "value": "hash(*) > 0"}], "id") is wide


def test_copies_between_steps_are_parquet(spark, df):
    from tabulon.session import checkpointed

    copy = checkpointed(df)
    assert all(f.endswith(".parquet") for f in copy.inputFiles()) and copy.inputFiles()
    assert copy.schema == df.schema and sorted(copy.collect(), key=str) == sorted(df.collect(), key=str)
    void = checkpointed(df.selectExpr("id", "null as nothing"))
    assert void.count() == df.count() and void.dtypes == [("id", "int"), ("nothing", "void")]
