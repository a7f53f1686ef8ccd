"""Column classes and validation. Nothing here starts a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


class ColumnError(ValueError):
    """An unknown column, or one of the wrong class."""


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not a number; booleans and timestamps included."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnError(f"unknown column(s): {', '.join(missing)}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise ColumnError(f"not numeric: {', '.join(wrong)}")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not use yet."""
    name = f"__{stem}"
    while name in df.columns:
        name = "_" + name
    return name
