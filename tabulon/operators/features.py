"""Feature preparation for regression: parsing, filling, encoding, scaling, splitting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.coerce import blank_to_null, number_of, to_number
from tabulon.operators.cleaning import fill_placeholder, placeholder
from tabulon.operators.ordered import dense_codes
from tabulon.operators.profiling import distinct_counts
from tabulon.operators.quantiles import column_quantiles
from tabulon.schema import present, ref, require, require_numeric

NUMERIC_SHARE = 0.85
MIN_ROWS = 10
MAX_CATEGORIES = 50
TEXT_OR_TIME = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)

# Columns that are never features.
NOT_FEATURES = ["entry_id", "title", "abstract_summary", "keywords", "language", "dataset_used", "publication_venue"]


def numeric_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, ratio, numeric_like)``: the share of non-null cells that parse as
    a number without thousands separators, for all columns in one aggregate."""
    require(df, *columns)
    ratio = lambda c: F.coalesce(
        F.try_divide(
            F.count_if(ref(c).isNotNull() & to_number(ref(c), True).isNotNull()).cast("double"), F.count(ref(c))
        ),
        F.lit(0.0),
    )
    row = df.agg(*[ratio(c).alias(f"r{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("ratio")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells))).withColumn("numeric_like", F.col("ratio") >= NUMERIC_SHARE)


def clean_target(df: DataFrame, target: str, check: bool = True) -> DataFrame:
    """Target as double, rows without one dropped; too few rows is an error."""
    require(df, target)
    out = df.withColumn(target, number_of(df, target, True)).where(ref(target).isNotNull())
    if check:
        enough_rows(out, target)
    return out


def enough_rows(df: DataFrame, target: str) -> None:
    rows = df.select(ref(target)).limit(MIN_ROWS).count()
    if rows < MIN_ROWS:
        raise ValueError(f"only {rows} rows with a target, at least {MIN_ROWS} are needed")


def split_classes(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric-like, other) columns."""
    like = {row["column"] for row in numeric_like(df, columns).where("numeric_like").collect()}
    return [c for c in columns if c in like], [c for c in columns if c not in like]


def impute_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers: median, or 0 without values. Categories: placeholder."""
    numeric, other = split_classes(df, columns)
    parsed = df.withColumns({c: number_of(df, c, True) for c in numeric})
    found = column_quantiles(parsed, numeric, [0.5])
    filled = parsed.withColumns({c: F.coalesce(ref(c), F.lit(found[c][0] if found[c] else 0.0)) for c in numeric})
    return fill_placeholder(filled.withColumns({c: ref(c).cast("string") for c in other}), other)


def scale_constants(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """(centre, spread) per column; a spread of 0 counts as 1."""
    if not columns or method == "none":
        return {c: (0.0, 1.0) for c in columns}
    if method == "robust":
        found = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        pairs = {c: (q[1], q[2] - q[0]) if q else (0.0, 1.0) for c, q in found.items()}
    else:
        parts = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda x: F.max(x) - F.min(x))}
        if method not in parts:
            raise ValueError(f"unknown scaling: {method}")
        centre, spread = parts[method]
        row = df.agg(
            *[centre(number_of(df, c)).alias(f"c{i}") for i, c in enumerate(columns)],
            *[spread(number_of(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        pairs = {c: (row[f"c{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}
    return {c: (float(a), float(b) if b else 1.0) for c, (a, b) in pairs.items()}


def scaled(column: str, constants: dict[str, tuple[float, float]], value: Column | None = None) -> Column:
    centre, spread = constants[column]
    return ((ref(column).cast("double") if value is None else value) - F.lit(centre)) / F.lit(spread)


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Standard (population deviation), min-max or robust scaling in place."""
    require_numeric(df, *columns)
    constants = scale_constants(df, columns, method)
    return df.withColumns({c: scaled(c, constants) for c in columns})


def _indexer(columns: Sequence[str], outputs: Sequence[str]) -> StringIndexer:
    return StringIndexer(inputCols=list(columns), outputCols=list(outputs), stringOrderType="alphabetAsc", handleInvalid="keep")


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ascending code of each category, as ``<column>_code``; null stays null.

    Any number of categories: the code table is joined like any other table.
    """
    require(df, *columns)
    for i, name in enumerate(columns):
        codes = dense_codes(df, name).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"{name}_code"))
        df = df.join(codes, ref(name) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    return df


def categories(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Sorted category values; more than ``limit`` of them is an error."""
    out = {}
    for name in columns:
        values = df.select(ref(name).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
        if len(values) > limit:
            raise ValueError(f"{name} has more than {limit} categories")
        out[name] = sorted(row["v"] for row in values)
    return out


def one_hot(df: DataFrame, columns: Sequence[str], known: dict[str, list[str]] | None = None) -> DataFrame:
    """One 0/1 column ``<column>_<value>`` per category; unseen values give zeros."""
    require(df, *columns)
    known = categories(df, columns) if known is None else known
    flags = {
        f"{c}_{v}": F.coalesce((ref(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0)) for c in columns for v in known[c]
    }
    return df.withColumns(flags).drop(*columns)


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same rows in every run."""
    require(df, key)
    place = F.pmod(F.xxhash64(ref(key), F.lit(seed)), F.lit(10_000))
    limit = round(test_share * 10_000)
    return df.where(place >= limit), df.where(place < limit)


def select_features(df: DataFrame, target: str, max_categories: int = MAX_CATEGORIES, exclude: Sequence[str] = tuple(NOT_FEATURES)) -> list[str]:
    """Usable columns: no identifiers, no text, no column of text or times with many values.
    Dates are text in the files that this rule was made for."""
    candidates = [c for c in df.columns if c not in exclude and c != target]
    text = present(df.select(*[ref(f.name) for f in df.schema.fields if isinstance(f.dataType, TEXT_OR_TIME)]), candidates)
    if text:
        sketch = {r["column"]: r["distinct"] for r in distinct_counts(df, text, approx=True).collect()}
        near = [c for c in text if sketch[c] <= 4 * max_categories]
        exact = {r["column"]: r["distinct"] for r in distinct_counts(df, near).collect()} if near else {}
        dropped = {c for c in text if c not in near or exact.get(c, 0) > max_categories}
        candidates = [c for c in candidates if c not in dropped]
    if len(candidates) < 2:
        raise ValueError(f"not enough feature columns for target {target}")
    return candidates


@dataclass
class FeatureModel:
    """Everything learnt from the training rows to turn raw rows into vectors."""

    numeric: list[str]
    categorical: list[str]
    fills: dict[str, float]
    constants: dict[str, tuple[float, float]]
    encoder: PipelineModel | None
    names: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame, absent: str = "fill") -> DataFrame:
        """Add ``features``. With ``absent="zero"`` a missing number is 0 before
        scaling, as in scoring of single raw rows; else the training median."""
        out = {}
        for i, name in enumerate(self.numeric):
            value = number_of(df, name, True) if name in df.columns else F.lit(None).cast("double")
            fill = 0.0 if absent == "zero" else self.fills[name]
            out[f"__n{i}"] = scaled(name, self.constants, F.coalesce(value, F.lit(fill)))
        for i, name in enumerate(self.categorical):
            value = blank_to_null(ref(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
            out[f"__c{i}"] = F.coalesce(value, F.lit(placeholder(name)))
        wide = self.encoder.transform(df.withColumns(out))
        return wide.drop(*[c for c in wide.columns if c.startswith("__")])


def fit_features(train: DataFrame, columns: Sequence[str], method: str = "standard", encode: bool = True) -> FeatureModel:
    """Learn classes, fills, scales and categories from the training rows only.

    ``encode``: one-hot vectors, else alphabetical codes.
    """
    require(train, *columns)
    numeric, categorical = split_classes(train, columns)
    parsed = train.select(*[number_of(train, c, True).alias(c) for c in numeric]) if numeric else train
    found = column_quantiles(parsed, numeric, [0.5])
    fills = {c: (q[0] if q else 0.0) for c, q in found.items()}
    filled = parsed.fillna(fills) if fills else parsed
    model = FeatureModel(numeric, categorical, fills, scale_constants(filled, numeric, method), None)
    raw, codes, hot = ([f"__{k}{i}" for i in range(len(categorical))] for k in ("c", "i", "h"))
    numbers = [f"__n{i}" for i in range(len(numeric))]
    stages = []
    if categorical:
        stages.append(_indexer(raw, codes))
        if encode:
            stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True))
    stages.append(VectorAssembler(inputCols=numbers + ((hot if encode else codes) if categorical else []), outputCol="features"))
    cells = {c: F.lit(0.0) for c in numbers}
    cells |= {r: F.coalesce(blank_to_null(ref(c).cast("string")), F.lit(placeholder(c))) for r, c in zip(raw, categorical)}
    model.encoder = Pipeline(stages=stages).fit(train.select(*[v.alias(k) for k, v in cells.items()]))
    model.names = list(numeric)
    for i, name in enumerate(categorical):
        labels = model.encoder.stages[0].labelsArray[i]
        model.names += [f"{name}_{v}" for v in labels] if encode else [name]
    return model
