"""Reading wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tabulon.functions.coerce import nonfinite_to_null, strip, to_number
from tabulon.schema import ref, require, string_columns

# CSV cells that mean "missing".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]

WHOLE = r"^[+-]?[0-9]+$"


def load_table(
    spark: SparkSession,
    candidates: str | Sequence[str],
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    multiline: bool = False,
    rejects: Observation | None = None,
) -> DataFrame:
    """Read the first candidate path that exists, with names and cells trimmed.

    CSV cells are read as text, marks of missing values become null, and types
    are inferred over the whole file in one extra pass, unless ``schema`` names
    them. ``multiline`` allows line breaks in quoted cells, but such a file can
    not be split over tasks. With ``rejects``, the first action on a CSV table also
    counts its rows and, per column, the cells and those that did not fit their type.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    paths = [candidates] if isinstance(candidates, str) else list(candidates)
    for path in paths:
        reader = spark.read
        if fmt == "csv":
            reader = reader.options(header=True, inferSchema=False, escape='"', multiLine=multiline)
        elif schema is not None:
            reader = reader.schema(schema)
        try:
            df = reader.format(fmt).load(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        df = trim_strings(trim_headers(df))
        if fmt == "csv":
            df = df.select(*[F.when(~ref(c).isin(MISSING), ref(c)).alias(c) for c in df.columns])
            if schema is None and rejects is None:
                df = infer_types(df)
            else:
                df = apply_types(df, inferred_schema(df) if schema is None else schema, rejects)
        return nonfinite_to_null(df)
    raise FileNotFoundError(f"none of these exists: {paths}")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip string columns; nulls stay null."""
    names = string_columns(df) if columns is None else list(columns)
    require(df, *names)
    return df.withColumns({name: strip(ref(name)) for name in names})


def _typed(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return ref(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return to_number(ref(name)).cast(kind)
    return ref(name).try_cast(kind)


def apply_types(df: DataFrame, schema: T.StructType, rejects: Observation | None = None) -> DataFrame:
    """Text columns to the types of ``schema``; cells that do not fit become null.

    ``rejects`` takes the metrics ``rows``, ``cells <column>`` (not null before) and
    ``rejects <column>`` (null only after), which the tasks count as they read: no
    pass of its own, and no cell is lost unseen.
    """
    require(df, *schema.fieldNames())
    typed = {f.name: _typed(f.name, f.dataType) for f in schema.fields}
    if rejects is None:
        return df.select(*[x.alias(name) for name, x in typed.items()])
    both = df.select(*[ref(name).alias(f"text {name}") for name in typed], *[x.alias(name) for name, x in typed.items()])
    lost = lambda name: ref(f"text {name}").isNotNull() & ref(name).isNull()
    metrics = [F.count(F.lit(1)).alias("rows")]
    for name in typed:
        metrics += [F.count(ref(f"text {name}")).alias(f"cells {name}"), F.count_if(lost(name)).alias(f"rejects {name}")]
    return both.observe(rejects, *metrics).select(*[ref(name) for name in typed])


def reject_counts(df: DataFrame, rejects: Observation) -> DataFrame:
    """``(column, dtype, cells, rejects)`` of a loaded table, once an action has read it."""
    seen = rejects.get
    rows = [(name, kind, seen[f"cells {name}"], seen[f"rejects {name}"]) for name, kind in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, cells bigint, rejects bigint")


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to the types of ``inferred_schema``."""
    found = {f.name: f.dataType for f in inferred_schema(df).fields}
    return df.withColumns({name: _typed(name, found[name]) for name in string_columns(df)})


def inferred_schema(df: DataFrame) -> T.StructType:
    """bigint, double or boolean for text columns where every cell fits; a column
    without values counts as numeric. Dates stay text. One pass for all columns."""
    columns = string_columns(df)
    tests = {
        "bigint": lambda c: c.rlike(WHOLE) & c.try_cast("bigint").isNotNull(),
        "double": lambda c: to_number(c).isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
    }
    row = df.agg(
        *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(test(ref(c))).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, test in tests.items()],
    ).first()
    found = {}
    for i, name in enumerate(columns):
        fits = [kind for kind in tests if row[f"{kind}{i}"] == row[f"n{i}"]]
        kind = "double" if row[f"n{i}"] == 0 else fits[0] if fits else "string"
        found[name] = T.StructType.fromDDL(f"c {kind}")[0].dataType
    return T.StructType([T.StructField(f.name, found.get(f.name, f.dataType)) for f in df.schema.fields])
