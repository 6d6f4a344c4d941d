"""Text files in, token lines out; any store that Spark reads and writes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, blank lines kept."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per line, each a text of its own."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_lines(df: DataFrame, path: str, form: str = "text", text: str = "text", keys: tuple[str, ...] = ("doc_id",), mode: str = "errorifexists", **options: Any) -> None:
    """Write the output lines of each text below ``path``: text (a sentence a line), csv or json.

    Lines of one text stay together and in order; texts keep the order of ``df``.
    """
    frames.lines(df, form, text, keys, **options).select("value").write.mode(mode).text(path)


def write_tokens(df: DataFrame, path: str, mode: str = "errorifexists", **options: Any) -> None:
    """Write token rows as Parquet, the form for further queries."""
    frames.tokens(df, **options).write.mode(mode).parquet(path)
