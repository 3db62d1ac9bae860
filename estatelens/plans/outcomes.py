"""Conversion outcomes: what a converter reported, as rows of ``conversion_results``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens import schemas
from estatelens.functions import scalars as S
from estatelens.operators.merge import merge
from estatelens.plans.packages import count_cells, unsupported_types
from estatelens.session import durable

KEY = ["file_name"]


def failure_reason(kind: Column, message: Column) -> Column:
    """``Type: first line of the message``, the whole line; displays may cut it."""
    return F.concat(kind, F.lit(": "), S.first_line(message))


def object_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts ``(file_name, file_type, engine, success_count, errors, exception_type,
    exception_message)`` as outcome rows.

    An attempt is fine when it reports no error; an exception counts as one error and no success.
    """
    failed = F.col("exception_type").isNotNull()
    errors = F.coalesce(F.size("errors"), F.lit(0))
    reported = F.when(errors > 0, F.array_join("errors", "; "))
    rows = attempts.select(
        "file_name",
        "file_type",
        "engine",
        F.when(failed, 0).otherwise(F.col("success_count")).alias("success_count"),
        F.when(failed, 1).otherwise(errors).alias("error_count"),
        (~failed & (errors == 0)).alias("transpiled"),
        F.when(failed, failure_reason(F.col("exception_type"), F.col("exception_message")))
        .otherwise(reported)
        .alias("failure_reason"),
        F.lit(V.SCOPE_OBJECT).alias("transpilation_scope"),
    )
    return schemas.conform(rows, schemas.CONVERSION_RESULTS)


def success_rate(outcomes: DataFrame) -> DataFrame:
    """Objects, converted objects, and the whole percentage rounded down (0 for no objects)."""
    return outcomes.agg(
        F.count("*").alias("objects"),
        F.coalesce(F.sum(F.col("transpiled").cast("bigint")), F.lit(0)).alias("converted"),
    ).withColumn(
        "percent",
        F.floor(F.col("converted") * 100 / F.greatest("objects", F.lit(1))).cast("bigint"),
    )


def package_outcomes(
    packages: DataFrame, outputs: DataFrame, diagnostics: DataFrame, engine: str = "package_rules"
) -> DataFrame:
    """Packages ``(path, xml)``, files written for them ``(path, output_file, code)`` and messages
    ``(path, ord, message)`` as outcome rows.

    A package is converted when files came out, no message was raised, some Spark SQL was emitted and
    no component needs a manual rewrite.
    """
    messages = diagnostics.groupBy("path").agg(
        F.array_sort(
            F.collect_list(F.struct("ord", S.first_line("message").alias("line")))
        ).alias("messages")
    )
    rows = (
        packages.select("path", unsupported_types(F.col("xml")).alias("unsupported"))
        .join(count_cells(outputs), "path", "left")
        .join(messages, "path", "left")
        .withColumns(
            {
                "cells": F.coalesce("sql_cells", F.lit(0)),
                "lines": F.coalesce("messages.line", F.array().cast("array<string>")),
                "manual": F.size("unsupported") > 0,
            }
        )
    )
    cells = F.col("cells")
    rows = rows.withColumn(
        "ok",
        F.col("output_files").isNotNull() & (F.size("lines") == 0) & (cells > 0) & ~F.col("manual"),
    )
    rewrite = F.concat(F.lit(V.REASON_MANUAL), F.array_join("unsupported", ", "))
    reasons = F.when(F.col("manual"), F.array_append("lines", rewrite)).otherwise(F.col("lines"))
    nothing = ~F.col("ok") & (F.size(reasons) == 0)
    reason = F.when(nothing, V.REASON_NO_SQL).otherwise(
        F.nullif(F.array_join(reasons, "; "), F.lit(""))
    )
    text = cells.cast("string")
    scope = (
        F.when(F.col("ok"), F.concat(F.lit(V.SCOPE_CONVERTED[0]), text, F.lit(V.SCOPE_CONVERTED[1])))
        .when(cells > 0, F.concat(F.lit(V.SCOPE_PARTIAL[0]), text, F.lit(V.SCOPE_PARTIAL[1])))
        .otherwise(V.SCOPE_NOT_CONVERTED)
    )
    out = rows.select(
        F.col("path").alias("file_name"),
        F.lit("SSIS Package").alias("file_type"),
        F.lit(engine).alias("engine"),
        cells.alias("success_count"),
        F.size("lines").alias("error_count"),
        F.col("ok").alias("transpiled"),
        reason.alias("failure_reason"),
        scope.alias("transpilation_scope"),
        F.col("output_files").alias("output_file"),
    )
    return schemas.conform(out, schemas.CONVERSION_RESULTS)


def merge_outcomes(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored outcomes with updates merged in by file name: all columns updated, new rows inserted."""
    target = schemas.conform(stored, schemas.CONVERSION_RESULTS)
    return merge(target, schemas.conform(updates, schemas.CONVERSION_RESULTS), KEY)


def outcomes_lifecycle(sql_rows: DataFrame, package_rows: DataFrame) -> DataFrame:
    """A run's outcome table: SQL rows replace everything, package rows are merged in after.

    Both are stored first: a merge reads its sides several times, and making the package rows takes
    joins over their texts.
    """
    return merge_outcomes(durable(sql_rows), durable(package_rows))
