"""File writes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_texts(files: DataFrame, folder: str, name: str = "output_file", text: str = "text") -> None:
    """One text per file: each goes to its own ``name=…`` subfolder, written by Spark's text sink."""
    files.select(name, text).write.mode("overwrite").partitionBy(name).option("lineSep", "\n").text(folder)


def write_flat_file(df: DataFrame, folder: str, header: bool = True, delimiter: str = ",") -> None:
    """A delimited flat file per partition."""
    df.write.mode("overwrite").option("header", header).option("sep", delimiter).csv(folder)
