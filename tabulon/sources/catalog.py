"""Named variants of one table: original, cleaned, extended."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

VARIANTS = ("original", "cleaned", "extended")


def extend(df: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append rows by column name; columns missing on one side are null."""
    if new_rows.isEmpty():
        raise ValueError("no rows to append")
    return df.unionByName(new_rows, allowMissingColumns=True)


def extend_counts(df: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row: total and added rows after an append."""
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("m")).union(
        new_rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("m"))
    )
    return sizes.agg(F.sum("n").alias("total_rows"), F.sum("m").alias("added_rows"))


class Catalog:
    """Variants by name. A variant that was never set reads as the original."""

    def __init__(self, original: DataFrame):
        self._frames = {"original": original}

    def get(self, name: str = "original") -> DataFrame:
        """Unknown names read as the original, too."""
        return self._frames.get(name, self._frames["original"])

    def put(self, name: str, df: DataFrame) -> None:
        if name not in VARIANTS:
            raise ValueError(f"unknown variant: {name}")
        self._frames[name] = df

    def extend(self, new_rows: DataFrame) -> DataFrame:
        self.put("extended", extend(self.get("original"), new_rows))
        return self.get("extended")

    def reset(self) -> None:
        self._frames = {"original": self._frames["original"]}

    def loaded(self) -> list[str]:
        return [name for name in VARIANTS if name in self._frames]
