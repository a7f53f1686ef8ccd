"""Null-safe string, number and date coercion as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.schema import float_columns, ref

# The characters that count as whitespace at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Fixed value: the shape of a finite decimal number. Words such as "nan" and
# suffixed numbers such as "5d" must not pass, though a plain cast takes them.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(value: Column) -> Column:
    """Drop whitespace at both ends; null stays null."""
    return F.btrim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    return F.when(strip(value) != "", value)


def finite(value: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_number(value: Column, thousands: bool = False) -> Column:
    """Text to double; whatever is not a finite decimal number becomes null."""
    text = value.cast("string")
    if thousands:
        text = F.replace(text, F.lit(","), F.lit(""))
    text = strip(text)
    return finite(F.when(text.rlike(NUMBER), text.try_cast("double")))


def number_of(df: DataFrame, name: str, thousands: bool = False) -> Column:
    """Like ``to_number``, but numeric columns are only cast."""
    from tabulon.schema import is_numeric

    if is_numeric(df, name):
        return finite(ref(name).cast("double"))
    return to_number(ref(name), thousands)


def to_timestamp(value: Column, formats: Sequence[str] = ()) -> Column:
    """Text to timestamp: the given formats in order, then the ISO form; else null."""
    text = strip(value.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and the infinities become null in every floating-point column."""
    return df.withColumns({name: finite(ref(name)) for name in float_columns(df)})
