"""Writers: files, tables, bundles of result tables keyed by run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SinkError(ValueError):
    """A target that cannot be written as asked."""


def complex_to_json(df: DataFrame) -> DataFrame:
    """Array, struct and map columns as JSON text, for text formats."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", sep: str = ",") -> None:
    complex_to_json(df).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_table(df: DataFrame, name: str, disposition: str = "truncate", *, path: str | None = None) -> None:
    """Catalog table, replaced or appended to; ``path`` keeps its files outside the warehouse folder."""
    modes = {"truncate": "overwrite", "append": "append"}
    if disposition not in modes:
        raise SinkError(f"unknown disposition {disposition!r}")
    writer = df.write.mode(modes[disposition])
    (writer.option("path", path) if path else writer).saveAsTable(name)


def export(df: DataFrame, mode: str, *, path: str | None = None, table: str | None = None, disposition: str = "truncate") -> None:
    """Result as csv, as table, or both; what the mode needs must be given."""
    if mode not in ("csv", "table", "both"):
        raise SinkError(f"unknown export mode {mode!r}")
    if mode != "table" and not path:
        raise SinkError("a csv export needs a path")
    if mode != "csv" and not table:
        raise SinkError("a table export needs a table name")
    if mode != "table":
        write_csv(df, path)
    if mode != "csv":
        write_table(df, table, disposition)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def write_bundle(tables: Mapping[str, DataFrame], folder: str, run_id: str) -> None:
    """Named results of one run; each table is partitioned by run, and only this run's part is replaced."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/{name}")
