"""A whole assessment: from a folder of scripts and packages to the stored tables.

Every table is written with its declared schema and replaced on each run, so a second run gives the
same tables. Converters are not part of this: their attempts come in as relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens import schemas
from estatelens.plans import corpus, inventory, metrics, outcomes, packages
from estatelens.session import durable
from estatelens.sinks import files, tables
from estatelens.sources.corpus import packages_of, scan_pieces, scripts_of
from estatelens.sources.literals import overhead_card, rate_card


def assess(
    spark: SparkSession,
    folder: str,
    database: str,
    unit_rates: list[tuple] | None = None,
    overhead_rates: list[tuple] | None = None,
) -> dict[str, DataFrame]:
    """Inventory, component, statement and rate tables of the files under ``folder``.

    Returns the stored tables by name; ``objects`` has the text of every object by its key.
    """
    tables.ensure_schema(spark, database)
    # the files are read once, cleaned once and split once; every later pass reads columns it needs
    found = durable(scan_pieces(spark, folder))
    scripts = durable(corpus.route_scripts(scripts_of(found)))
    pkgs = packages_of(found)
    objects = durable(corpus.objects(scripts))
    keyed = corpus.object_ids(objects)
    stored = {
        "objects": keyed,
        "functions": inventory.function_counts(scripts),
        "transformations": schemas.conform(
            packages.transformations(pkgs, packages.support_policy(spark)), schemas.TRANSFORMATIONS
        ),
        "sql_statements": schemas.conform(packages.embedded_sql(pkgs), schemas.SQL_STATEMENTS),
        "effort_hypothesis": rate_card(spark, unit_rates),
        "overhead_hypothesis": overhead_card(spark, overhead_rates),
    }
    for name, df in stored.items():
        tables.overwrite(df, f"{database}.{name}")
    details = corpus.to_inventory(tables.read(spark, f"{database}.objects")).unionByName(
        packages.to_inventory(pkgs, F.col("path"))
    )
    tables.replace_conformed(details, f"{database}.job_details", schemas.JOB_DETAILS)
    return {name: tables.read(spark, f"{database}.{name}") for name in [*stored, "job_details"]}


def record_outcomes(
    spark: SparkSession,
    database: str,
    attempts: DataFrame,
    pkgs: DataFrame | None = None,
    outputs: DataFrame | None = None,
    diagnostics: DataFrame | None = None,
) -> DataFrame:
    """Replace the outcome table by the SQL attempts, with package outcomes merged in."""
    rows = outcomes.object_outcomes(attempts)
    if pkgs is not None:
        rows = outcomes.outcomes_lifecycle(
            rows, outcomes.package_outcomes(pkgs, outputs, diagnostics)
        )
    name = f"{database}.conversion_results"
    tables.replace_conformed(rows, name, schemas.CONVERSION_RESULTS)
    return tables.read(spark, name)


def write_converted(code: DataFrame, folder: str) -> DataFrame:
    """Write converted blocks ``(path, pos, code)`` to ``folder``, one text per source file.

    Returns ``(path, output_file)``, where each file's text went.
    """
    converted = durable(corpus.regroup_files(code))
    files.write_texts(converted, folder)
    return converted.select("path", "output_file")


def stage_failing(spark: SparkSession, database: str, folder: str) -> DataFrame:
    """Write every procedure that did not convert to ``folder``, one text each."""
    objects = tables.read(spark, f"{database}.objects").select(
        F.col("object_id").alias("file_name"), "source"
    )
    staged = corpus.stage_failing(tables.read(spark, f"{database}.conversion_results"), objects)
    files.write_texts(staged, folder, name="staged_as", text="source")
    return staged


def metric_views(spark: SparkSession, database: str) -> dict[str, metrics.MetricView]:
    """The two metric views over the stored tables."""
    details, results, card, overheads = _assessed(spark, database)
    return {
        "assessment_metrics": metrics.assessment_metrics(details, results),
        "effort_metrics": metrics.effort_metrics(details, results, card, overheads),
    }


def kpi_sheet(spark: SparkSession, database: str) -> DataFrame:
    """The headline figures of the stored tables."""
    return metrics.kpi_sheet(*_assessed(spark, database))


def _assessed(spark: SparkSession, database: str) -> list[DataFrame]:
    names = ["job_details", "conversion_results", "effort_hypothesis", "overhead_hypothesis"]
    return [tables.read(spark, f"{database}.{name}") for name in names]
