"""The inventory relations out of analyser reports and of the corpus itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens import schemas
from estatelens.functions import scalars as S
from estatelens.functions import text as X
from estatelens.sources.reports import by_position, tidy

JOB_REPORT = [
    "file_name",
    "folder",
    "source_file",
    "included",
    "job_type",
    "categorization",
    "number_of_nodes",
]


def report_rows(raw: DataFrame) -> DataFrame:
    """A job report as it was written: header tidied, blank rows gone, first seven columns by place."""
    return by_position(tidy(raw), JOB_REPORT)


def job_details(raw: DataFrame, platform: str) -> DataFrame:
    """A job report of one platform as inventory rows."""
    name = S.base_name("file_name")
    if platform == V.PLATFORM_PACKAGE:
        name = F.when(name.endswith(V.PACKAGE_SUFFIX), name).otherwise(
            F.concat(name, F.lit(V.PACKAGE_SUFFIX))
        )
    rows = report_rows(raw).select(
        F.lit(platform).alias("platform"),
        name.alias("file_name"),
        "job_type",
        "categorization",
        S.to_number("number_of_nodes").alias("number_of_nodes"),
        "included",
    )
    return schemas.conform(rows, schemas.JOB_DETAILS)


def combine(frames: list[DataFrame]) -> DataFrame:
    """Inventory rows of all platforms."""
    return reduce(DataFrame.unionByName, frames)


def by_type_and_size(inventory: DataFrame) -> DataFrame:
    """Objects per type and complexity."""
    return inventory.groupBy("job_type", "categorization").agg(F.count("*").alias("objects"))


def technologies(corpus: DataFrame) -> DataFrame:
    """One row: are there scripts, are there packages?"""
    package = F.col("path").endswith(V.PACKAGE_SUFFIX)
    return corpus.agg(
        F.coalesce(F.bool_or(~package), F.lit(False)).alias("has_scripts"),
        F.coalesce(F.bool_or(package), F.lit(False)).alias("has_packages"),
    )


def function_counts(scripts: DataFrame) -> DataFrame:
    """Calls per function name over all scripts, combined before the shuffle."""
    calls = scripts.select(F.explode(X.function_calls(F.col("text"))).alias("function_name"))
    counted = calls.groupBy("function_name").agg(F.count("*").alias("call_count"))
    return schemas.conform(
        counted.withColumn("platform", F.lit(V.PLATFORM_SQL)), schemas.FUNCTIONS
    )


def function_report(raw: DataFrame) -> DataFrame:
    """A function report: name and count by place, rows without a name dropped."""
    rows = by_position(tidy(raw), ["function_name", "call_count"]).na.drop(subset=["function_name"])
    counted = rows.withColumn("call_count", S.to_number("call_count"))
    return schemas.conform(
        counted.withColumn("platform", F.lit(V.PLATFORM_SQL)), schemas.FUNCTIONS
    )
