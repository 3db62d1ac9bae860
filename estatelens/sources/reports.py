"""Analyser reports as relations.

A report sheet is a CSV or parquet path. A sheet that is missing gives an empty relation instead of
an error, so a corpus with one technology only still runs; one with too few columns is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from estatelens import schemas
from estatelens.functions.scalars import normalize_header, to_number


def read_sheet(spark: SparkSession, path: str, schema: StructType, format: str = "csv") -> DataFrame:
    """The sheet at ``path``, its columns taken by position; empty if there is none."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(location):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    raw = reader.format(format).load(path)
    if len(raw.columns) < len(schema.fields):
        raise ValueError(f"{path} has {len(raw.columns)} columns, {len(schema.fields)} are needed")
    return schemas.conform(numbers(by_position(tidy(raw), schema.fieldNames()), schema), schema)


def numbers(df: DataFrame, schema: StructType) -> DataFrame:
    """Texts in number columns read leniently: ``3.0`` is 3, ``n/a`` is 0, null stays null."""
    found = dict(df.dtypes)
    texts = [f for f in schema.fields if isinstance(f.dataType, NumericType) and found[f.name] == "string"]
    return df.withColumns(
        {f.name: F.when(F.col(f.name).isNotNull(), to_number(f.name)).cast(f.dataType) for f in texts}
    )


def tidy(raw: DataFrame) -> DataFrame:
    """Header names normalised, wholly empty rows dropped."""
    return raw.toDF(*[normalize_header(c) for c in raw.columns]).na.drop("all")


def by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first columns under new names, whatever they were called."""
    picked = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return picked.select(*[picked[f"c{i}"].alias(name) for i, name in enumerate(names)])
