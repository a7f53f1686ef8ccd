"""Display forms of numbers and column names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds and suffixes of abbreviated numbers.
SUFFIXES = [(1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K")]


def _fixed(number: Column, digits: int) -> Column:
    """Decimals of the exact binary value, without thousands separators."""
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))


def format_number(value: Column) -> Column:
    """1.2K, 3.4M, 5.6B; whole numbers plain, others with 4 decimals; null as ``-``."""
    number = value.cast("double")
    size = F.abs(number)
    text = F.when(number.isNull() | F.isnan(number), F.lit("-"))
    for limit, suffix in SUFFIXES:
        text = text.when(size >= limit, F.concat(_fixed(number / F.lit(float(limit)), 1), F.lit(suffix)))
    return text.when(number == F.floor(number), _fixed(number, 0)).otherwise(_fixed(number, 4))


def column_label(name: Column) -> Column:
    """``funding_usd`` becomes ``Funding Usd``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
