"""Sinks: CSV, JSON and Parquet folders."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.operators.tables import simple_index
from siteroster.session import durable

# Spark has no spreadsheet writer; such a request is met with CSV.
FORMATS = {"csv": "csv", "xlsx": "csv", "json": "json", "parquet": "parquet"}


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists",
              delimiter: str = ",", partition_by: list[str] | None = None) -> str | None:
    """Header, chosen columns, quotes only where needed; nothing is written for an empty table."""
    chosen = df.select(*(columns or df.columns))
    if chosen.isEmpty():
        return None
    writer = chosen.write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"').option(
        "emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """Read back what ``write_csv`` wrote; an empty field is the empty text."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    texts = {f.name: F.coalesce(F.col(f.name), F.lit("")) for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.withColumns(texts)


def write_csv_simple(df: DataFrame, path: str, email: str, order: list[str], include_index: bool = True) -> str:
    """A list file with ``Index,Email`` or ``Email`` columns."""
    simple_index(df, email, order, include_index).write.option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return path


def write_outputs(df: DataFrame, folder: str, prefix: str = "extracted_emails", formats: tuple[str, ...] = ("csv", "xlsx"),
                  partition_by: list[str] | None = None) -> dict[str, str]:
    """One result in several formats below ``folder``; returns a path per format, none when empty.

    The rows are computed once and stored, then copied to each format.
    """
    stored = durable(df, "output")
    if stored.isEmpty():
        return {}
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    paths = {}
    for name in formats:
        if name not in FORMATS:
            raise ValueError(f"unsupported output format: {name}")
        path = f"{folder}/{prefix}_{stamp}_{name}"
        if FORMATS[name] == "csv":
            write_csv(stored, path, partition_by=partition_by)
        elif FORMATS[name] == "json":
            write_json(stored, path, partition_by=partition_by)
        else:
            writer = stored.write.partitionBy(*partition_by) if partition_by else stored.write
            writer.parquet(path)
        paths[name] = path
    return paths
