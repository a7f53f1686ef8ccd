"""Saved copies of table variants.

A snapshot is a folder with its rows and a manifest of one row, which is written last
and only if there is none: a failed or doubled write leaves no second entry. The list
is the manifests, read together.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F

INDEX_SCHEMA = "id string, variant string, label string, timestamp string, rows bigint, cols int"


class SnapshotStore:
    """Snapshots below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self, snapshot_id: str) -> str:
        return f"{self.root}/data/{snapshot_id}/rows"

    def _manifest(self, snapshot_id: str) -> str:
        return f"{self.root}/data/{snapshot_id}/manifest"

    def take(self, df: DataFrame, variant: str, label: str = "") -> str:
        if variant not in ("cleaned", "extended"):
            raise ValueError("only the cleaned and the extended variant can be saved")
        now = datetime.now(timezone.utc)
        snapshot_id = f"SNAP-{variant}-{now:%Y%m%d_%H%M%S_%f}"
        df.write.mode("error").parquet(self._rows(snapshot_id))
        rows = self.spark.read.schema(df.schema).parquet(self._rows(snapshot_id)).count()
        row = (snapshot_id, variant, label or f"{variant} snapshot", now.isoformat(), rows, len(df.columns))
        self.spark.createDataFrame([row], INDEX_SCHEMA).coalesce(1).write.mode("error").parquet(self._manifest(snapshot_id))
        return snapshot_id

    def _found(self, reader: DataFrameReader, path: str, fmt: str) -> DataFrame | None:
        try:
            return reader.format(fmt).load(path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def list(self, variant: str | None = None) -> DataFrame:
        """Manifests whose rows are still there: one read of all manifests, semi-joined with
        one listing of the files of rows, however many snapshots there are."""
        manifests = self._found(self.spark.read.schema(INDEX_SCHEMA), self._manifest("*"), "parquet")
        files = self._found(self.spark.read, f"{self._rows('*')}/*.parquet", "binaryFile")
        if manifests is None or files is None:
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        present = files.select(F.regexp_extract("path", r"/data/([^/]+)/rows/", 1).alias("id")).distinct()
        found = manifests.join(present, "id", "left_semi")
        return found if variant is None else found.where(F.col("variant") == variant)

    def restore(self, snapshot_id: str) -> tuple[str, DataFrame]:
        """The variant name and its data."""
        manifest = self._found(self.spark.read.schema(INDEX_SCHEMA), self._manifest(snapshot_id), "parquet")
        row = manifest.first() if manifest is not None else None
        df = self._found(self.spark.read, self._rows(snapshot_id), "parquet") if row else None
        if df is None:
            raise KeyError(f"no snapshot {snapshot_id}")
        return row["variant"], df
