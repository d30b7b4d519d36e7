"""JSON documents and CSV sheets in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """A document by a stated schema: nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_document(rows: DataFrame, *columns: str) -> DataFrame:
    """document: each row as JSON text, without its null fields."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("document"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def sheet_readme(counts: dict[str, int], as_of: str) -> str:
    """A text that names the sheets and their rows."""
    lines = [f"Sheets of {as_of}", ""] + [f"- {name}: {n} rows" for name, n in sorted(counts.items())]
    return "\n".join([*lines, "", "Prices are asking prices. Empty cells are unknown, not zero."])
