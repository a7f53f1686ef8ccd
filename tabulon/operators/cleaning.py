"""Cleaning steps: each one takes a frame and returns a frame.

Steps that need a statistic of the data (a mean, a mode, quartiles) run one
small aggregate and put the result into the plan as a constant, so the cleaned
frame stays one narrow plan without joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions import coerce
from tabulon.operators import ordered
from tabulon.operators.filters import filter_rows
from tabulon.operators.quantiles import column_median, column_quantiles
from tabulon.operators.topk import top_per_group, value_counts
from tabulon.schema import categorical_columns, is_numeric, numeric_columns, present, ref, require, require_numeric
from tabulon.session import checkpointed, scratch_dir

# What a missing category is called, by the first rule whose text
# occurs in the column name.
PLACEHOLDERS = [
    (("policy",), "not_policy"),
    (("patent",), "no_patent"),
    (("publication", "venue"), "no_publication"),
    (("organization",), "unknown_organization"),
    (("dataset",), "unknown_dataset"),
    (("country",), "unknown_country"),
    (("region",), "unknown_region"),
]
ORGANIZATION_SUFFIX = "org"

# Columns that get the placeholder even when they have a mode.
ALWAYS_PLACEHOLDER = [
    "policy_type",
    "policy_level",
    "policy_stringency_score",
    "patent_class",
    "patent_family_size",
    "publication_venue",
    "open_access",
]

# Identifiers and free text, dropped by the automatic cleaning.
TEXT_COLUMNS = ["entry_id", "title", "abstract_summary", "keywords"]


def placeholder(column: str) -> str:
    name = column.lower()
    for parts, text in PLACEHOLDERS:
        if any(part in name for part in parts):
            return text
        if text == "unknown_organization" and name.endswith(ORGANIZATION_SUFFIX):
            return text
    return "unknown"


# ---- missing values ---------------------------------------------------------


def drop_na_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.dropna(subset=[column] if column else None)


def drop_na_cols(df: DataFrame) -> DataFrame:
    """Drop the columns without any value."""
    row = df.agg(*[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0])


def _fill_numbers(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Fill nulls; an integer column becomes double only for a fractional value."""
    out = {}
    for name, value in values.items():
        if value is None:
            continue
        whole = isinstance(df.schema[name].dataType, T.IntegralType) and float(value).is_integer()
        kind = df.schema[name].dataType if whole else T.DoubleType()
        out[name] = F.coalesce(ref(name).cast(kind), F.lit(value).cast(kind))
    return df.withColumns(out) if out else df


def _with_nulls(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], int]:
    """Columns that have nulls, and the number of rows."""
    nulls = [F.count_if(ref(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *nulls).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"]], row["rows"]


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """Nulls to the mean; a column without nulls is left alone."""
    require_numeric(df, column)
    x = coerce.finite(ref(column).cast("double"))
    row = df.agg(F.avg(x).alias("mean"), F.count_if(ref(column).isNull()).alias("nulls")).first()
    return _fill_numbers(df, {column: row["mean"]}) if row["nulls"] else df


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians of all columns in one pass; columns without nulls are left alone."""
    columns = [c for c in present(df, columns) if is_numeric(df, c)]
    if not columns:
        return df
    gaps, rows = _with_nulls(df, columns)
    return _fill_numbers(df, column_median(df, gaps, rows=rows))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Smallest of the most frequent values; empty text for a text column without values."""
    require(df, column)
    counts = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("value")).count()
    best = counts.orderBy(F.desc("count"), "value").limit(1).collect()
    if best:
        fill = F.lit(best[0]["value"]).cast(df.schema[column].dataType)
    elif isinstance(df.schema[column].dataType, T.StringType):
        fill = F.lit("")
    else:
        return df
    return df.withColumn(column, F.coalesce(ref(column), fill))


def fill_mode_or_placeholder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blanks count as missing. Structural columns get their placeholder, and become
    text if they are numbers; the others get their mode, or the placeholder if
    they have none. Of equally frequent values the smallest is the mode, numbers
    compared as numbers."""
    columns = present(df, columns)
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    df = df.withColumns({c: coerce.blank_to_null(ref(c)) for c in text})
    by_mode = [c for c in columns if c not in ALWAYS_PLACEHOLDER]
    modes = {}
    if by_mode:
        numbers = [c for c in by_mode if is_numeric(df, c)]
        as_number = F.when(F.col("column").isin(numbers), F.col("value").try_cast("double"))
        best = top_per_group(value_counts(df, by_mode).withColumn("number", as_number), ["column"], [F.desc("count"), F.col("number"), F.col("value")], 1)
        modes = {row["column"]: row["value"] for row in best.collect()}
    out = {}
    for name in columns:
        fill = modes.get(name, placeholder(name) if name in text else None)
        if name in ALWAYS_PLACEHOLDER and name not in text:
            out[name] = F.coalesce(ref(name).cast("string"), F.lit(placeholder(name)))
        elif fill is not None:
            out[name] = F.coalesce(ref(name), F.lit(fill).cast(df.schema[name].dataType))
    return df.withColumns(out)


def fill_placeholder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank or missing categories get the placeholder of their column name."""
    require(df, *columns)
    return df.withColumns({c: F.coalesce(coerce.blank_to_null(ref(c)), F.lit(placeholder(c))) for c in columns})


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    require(df, column)
    if value is None:
        return df
    return df.withColumn(column, F.coalesce(ref(column), F.lit(value).cast(df.schema[column].dataType)))


# ---- outliers ---------------------------------------------------------------


def remove_outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Keep rows less than ``threshold`` sample deviations from the mean; nulls and
    non-finite values go, and count for neither."""
    require_numeric(df, column)
    x = coerce.finite(ref(column).cast("double"))
    row = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).first()
    if not row["std"]:
        return df.where(F.lit(False))
    return df.where(F.abs((x - F.lit(row["mean"])) / F.lit(row["std"])) < threshold)


def _iqr_bounds(df: DataFrame, column: str, factor: float, rows: int | None) -> tuple[float, float, float] | None:
    found = column_quantiles(df, [column], [0.25, 0.75], rows=rows)[column]
    if found is None:
        return None
    low, high = found
    return low - factor * (high - low), high + factor * (high - low), high - low


def remove_outliers_iqr(df: DataFrame, column: str, factor: float = 1.5, rows: int | None = None) -> DataFrame:
    """Keep rows between the fences; nulls go. ``rows``: known bound of the row count."""
    require_numeric(df, column)
    bounds = _iqr_bounds(df, column, factor, rows)
    if bounds is None:
        return df.where(F.lit(False))
    return df.where(ref(column).between(F.lit(bounds[0]), F.lit(bounds[1])))


def remove_outliers_iqr_keep_nulls(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Column after column, each on the rows the former ones left; nulls stay, and
    a column without spread is skipped."""
    columns = [c for c in present(df, columns) if is_numeric(df, c)]

    def step(frame: DataFrame, name: str, rows: int) -> Column | None:
        bounds = _iqr_bounds(frame, name, factor, rows)
        if bounds is None or not bounds[2] > 0:
            return None
        return ref(name).between(F.lit(bounds[0]), F.lit(bounds[1])) | ref(name).isNull()

    return _sequential(df, columns, step)


def _sequential(df: DataFrame, columns: Sequence[str], step: Callable[[DataFrame, str, int], Column | None]) -> DataFrame:
    """Apply one filter per column, each derived from the rows that are left.

    Only the measured columns are written to the shared folder and read from there by
    the passes, in as many tasks as their bytes ask for. The result is the input under
    constant conditions; it does not depend on the written copy.
    """
    if not columns:
        return df
    measured = df.select(*[ref(c) for c in dict.fromkeys(columns)])
    path = scratch_dir(df.sparkSession, "measured")
    measured.write.parquet(path)
    left = df.sparkSession.read.schema(measured.schema).parquet(path)
    rows, conditions = left.count(), []
    for name in columns:
        condition = step(left, name, rows)
        if condition is not None:
            conditions.append(condition)
            left = left.where(condition)
    for condition in conditions:
        df = df.where(condition)
    return df


# ---- rows, text, types, columns ---------------------------------------------


def remove_duplicates(df: DataFrame, column: str | None = None, order_by: str | None = None) -> DataFrame:
    """First row per key in ``order_by`` order, or distinct whole rows."""
    if column is None:
        return df.dropDuplicates()
    if order_by is None:
        raise ValueError("keep-first needs order_by")
    require(df, column, order_by)
    return top_per_group(df, [column], [ref(order_by)], 1, rank="__row").drop("__row")


def strip_whitespace(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.withColumn(column, coerce.strip(ref(column).cast("string")))


def lowercase(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.withColumn(column, F.lower(ref(column).cast("string")))


def to_numeric(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df if is_numeric(df, column) else df.withColumn(column, coerce.to_number(ref(column)))


def to_datetime(df: DataFrame, column: str, formats: Sequence[str] = ()) -> DataFrame:
    require(df, column)
    return df.withColumn(column, coerce.to_timestamp(ref(column), formats))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*present(df, columns))


def rename_column(df: DataFrame, column: str, new: str) -> DataFrame:
    require(df, column)
    return df.withColumnRenamed(column, new)


# ---- composed cleaning ------------------------------------------------------


def auto_clean(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Drop identifiers and text, fill numbers and categories, then filter on
    every numeric column in turn. Columns without values do not filter."""
    df = drop_columns(df, TEXT_COLUMNS)
    df = fill_median(df, numeric_columns(df))
    df = fill_mode_or_placeholder(df, categorical_columns(df))

    def step(frame: DataFrame, name: str, rows: int) -> Column | None:
        bounds = _iqr_bounds(frame, name, factor, rows)
        return None if bounds is None else ref(name).between(F.lit(bounds[0]), F.lit(bounds[1]))

    return _sequential(df, numeric_columns(df), step)


@dataclass(frozen=True)
class Operation:
    """One entry of the step catalog."""

    id: str
    label: str
    needs_column: bool
    needs_value: bool
    run: Callable[[DataFrame, str | None, object, str | None], DataFrame]
    numeric_only: bool = False


# Column-bound steps get (df, column, value, order_by).
OPERATIONS = {
    op.id: op
    for op in [
        Operation("drop_na_rows", "Remove rows with nulls", True, False, lambda d, c, v, o: drop_na_rows(d, c)),
        Operation("drop_na_cols", "Remove columns without values", False, False, lambda d, c, v, o: drop_na_cols(d)),
        Operation("fill_na_mean", "Nulls to mean", True, False, lambda d, c, v, o: fill_mean(d, c), True),
        Operation("fill_na_median", "Nulls to median", True, False, lambda d, c, v, o: fill_median(d, [c]), True),
        Operation("fill_na_mode", "Nulls to mode", True, False, lambda d, c, v, o: fill_mode(d, c)),
        Operation("fill_na_constant", "Nulls to a constant", True, True, lambda d, c, v, o: fill_constant(d, c, v)),
        Operation("fill_na_ffill", "Nulls to the value before", True, False, lambda d, c, v, o: ordered.fill_forward(d, [c], o)),
        Operation("fill_na_bfill", "Nulls to the value after", True, False, lambda d, c, v, o: ordered.fill_backward(d, [c], o)),
        Operation("interpolate", "Nulls by linear interpolation", True, False, lambda d, c, v, o: ordered.interpolate(d, c, o), True),
        Operation(
            "remove_outliers_zscore", "Remove rows by z-score", True, True,
            lambda d, c, v, o: remove_outliers_zscore(d, c, float(v or 3)), True,
        ),
        Operation(
            "remove_outliers_iqr", "Remove rows by interquartile range", True, True,
            lambda d, c, v, o: remove_outliers_iqr(d, c, float(v or 1.5)), True,
        ),
        Operation("remove_duplicates", "Remove repeated rows", False, False, lambda d, c, v, o: remove_duplicates(d, c, o)),
        Operation("strip_whitespace", "Strip whitespace", True, False, lambda d, c, v, o: strip_whitespace(d, c)),
        Operation("lowercase", "Lower case", True, False, lambda d, c, v, o: lowercase(d, c)),
        Operation("to_numeric", "Text to number", True, False, lambda d, c, v, o: to_numeric(d, c)),
        Operation("to_datetime", "Text to timestamp", True, False, lambda d, c, v, o: to_datetime(d, c)),
        Operation("drop_column", "Remove a column", True, False, lambda d, c, v, o: drop_columns(d, [c])),
        Operation("rename_column", "Rename a column", True, True, lambda d, c, v, o: rename_column(d, c, str(v))),
        Operation("filter_rows", "Keep rows by condition", False, True, lambda d, c, v, o: filter_rows(d, str(v))),
    ]
}
ORDERED_OPERATIONS = ("fill_na_ffill", "fill_na_bfill", "interpolate")
# Steps that read the data before they are planned.
MEASURING_OPERATIONS = (
    *ORDERED_OPERATIONS, "drop_na_cols", "fill_na_mean", "fill_na_median", "fill_na_mode", "remove_outliers_zscore", "remove_outliers_iqr",
)


def validate_steps(steps: Sequence[Mapping], order_by: str | None) -> None:
    for step in steps:
        op = OPERATIONS.get(step.get("operation"))
        if op is None:
            raise ValueError(f"unknown cleaning operation: {step.get('operation')}")
        if op.id in ("rename_column", "filter_rows") and not step.get("value"):
            raise ValueError(f"{op.id} needs a value")
        keyed = op.id == "remove_duplicates" and step.get("column")
        if (op.id in ORDERED_OPERATIONS or keyed) and order_by is None:
            raise ValueError(f"{op.id} needs order_by")


def apply_steps(df: DataFrame, steps: Sequence[Mapping], order_by: str | None = None) -> DataFrame:
    """Run steps ``{operation, column, value}`` in order.

    A step whose column is missing, or has the wrong class, changes nothing; an
    unknown operation raises before anything runs. The shuffled result of an
    ordered or deduplicating step is checkpointed when a later step measures it.
    """
    validate_steps(steps, order_by)
    for place, step in enumerate(steps):
        op, column = OPERATIONS[step["operation"]], step.get("column")
        if column is not None and column not in df.columns:
            continue
        if column is None and op.needs_column and op.id != "drop_na_rows":
            continue
        if op.numeric_only and not is_numeric(df, column):
            continue
        df = op.run(df, column, step.get("value"), order_by)
        shuffled = op.id in ORDERED_OPERATIONS or op.id == "remove_duplicates"
        if shuffled and any(later["operation"] in MEASURING_OPERATIONS for later in steps[place + 1 :]):
            df = checkpointed(df)
    return df


def presence_only(df: DataFrame, steps: Sequence[Mapping], order_by: str | None = None) -> DataFrame:
    """The frame with true or null instead of the values that no step reads.

    For results that only count rows, columns and nulls: text that no step looks at is
    not carried through the shuffles and copies of the steps. Numbers, dates and columns
    that a condition may mention stay; so does everything when whole rows are compared.
    """
    if any(step["operation"] == "remove_duplicates" and not step.get("column") for step in steps):
        return df
    conditions = " ".join(str(step.get("value")).lower() for step in steps if step["operation"] == "filter_rows")
    if "*" in conditions:
        return df
    read = {order_by, *(step.get("column") for step in steps)}
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    unread = [f.name for f in df.schema.fields if isinstance(f.dataType, wide) and f.name not in read and f.name.lower().replace("`", "``") not in conditions]
    return df.withColumns({c: F.when(ref(c).isNotNull(), True) for c in unread}) if unread else df


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows, columns and null cells before and after."""
    size = lambda df, tag: df.agg(
        F.count(F.lit(1)).alias(f"rows_{tag}"),
        F.lit(len(df.columns)).alias(f"cols_{tag}"),
        sum((F.count_if(ref(c).isNull()) for c in df.columns), F.lit(0)).alias(f"nulls_{tag}"),
    ).withColumn("one", F.lit(1))
    return size(before, "before").join(size(after, "after"), "one").drop("one")


def apply_config(df: DataFrame, spec: Mapping) -> DataFrame:
    """Run a cleaning spec ``{cleaning: [{operation, columns, factor}]}``.

    The column selectors mean the classes of the columns before the first step.
    """
    selectors = {"__numeric__": numeric_columns(df), "__categorical__": categorical_columns(df)}
    runs = {
        "drop_columns": lambda d, cols, step: drop_columns(d, cols),
        "fill_na_median": lambda d, cols, step: fill_median(d, [c for c in cols if c in selectors["__numeric__"]]),
        "fill_na_mode": lambda d, cols, step: fill_mode_or_placeholder(d, cols),
        "remove_outliers_iqr": lambda d, cols, step: remove_outliers_iqr_keep_nulls(
            d, [c for c in cols if c in selectors["__numeric__"]], float(step.get("factor", 1.5))
        ),
        "drop_na_rows": lambda d, cols, step: d.dropna(),
        "drop_duplicates": lambda d, cols, step: d.dropDuplicates(),
    }
    steps = spec.get("cleaning") or []
    for step in steps:
        if step.get("operation") not in runs:
            raise ValueError(f"unknown cleaning operation: {step.get('operation')}")
    for step in steps:
        columns = step.get("columns") or []
        columns = selectors[columns] if isinstance(columns, str) else columns
        df = runs[step["operation"]](df, columns, step)
    return df
