"""Intake of tables: files and databases through Spark's readers, pandas and Arrow frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "csv", "json", "orc", "jdbc")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """A table from files (format by suffix unless given) or a database; only the named columns are read."""
    fmt = fmt or next((f for f in FORMATS if path.rstrip("/").endswith(f".{f}")), "parquet")
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if fmt == "csv":
        options = {"header": "true", "inferSchema": "true"} | options
    reader = spark.read.format(fmt).options(**options)
    df = reader.load() if fmt == "jdbc" else reader.load(path)
    return df.select(*columns) if columns else df


def intake(spark: SparkSession, data: Any) -> DataFrame:
    """A Spark DataFrame as it is; pandas, Arrow and frames that export Arrow are converted."""
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "__arrow_c_stream__") and not hasattr(data, "iloc"):
        import pyarrow as pa

        data = pa.table(data)
    return spark.createDataFrame(data)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    w = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        w = w.option("header", "true")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
