"""The datasets and aggregates behind the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens.plans.effort import man_days, rate_usage
from estatelens.plans.metrics import DistinctCount, MetricView, Percent, Total, assessment_rows

OBJECT, TRANSPILED, RATE = "Object", "Transpiled", "Transpilability Rate"


def rate_card_dataset(card: DataFrame, overheads: DataFrame) -> DataFrame:
    """Rates, then overheads, under their display names and in display order."""
    return _card_rows(card, overheads).orderBy("sort_key", "Object Type", "Complexity", "Status")


def _card_rows(card: DataFrame, overheads: DataFrame) -> DataFrame:
    rates = card.select(
        F.col("object_type").alias("Object Type"),
        F.col("complexity_level").alias("Complexity"),
        F.col("transpilability_status").alias("Status"),
        F.col("profile").alias("Profile"),
        F.col("effort_md_per_unit").alias("MD / Unit"),
        F.col("notes").alias("Notes"),
        F.lit(1).alias("sort_key"),
    )
    shares = overheads.select(
        F.lit(V.OVERHEAD_LABEL).alias("Object Type"),
        F.col("profile").alias("Complexity"),
        F.lit(None).cast("string").alias("Status"),
        F.col("profile").alias("Profile"),
        F.col("rate").alias("MD / Unit"),
        percent_note("rate", "notes").alias("Notes"),
        F.lit(2).alias("sort_key"),
    )
    return rates.unionByName(shares)


def percent_note(rate: str, notes: str) -> Column:
    """``10% of dev total — note``; the percentage is cut, not rounded (0.29 gives 28)."""
    percent = (F.col(rate) * 100).cast("int").cast("string")
    return F.concat(percent, F.lit("% of dev total — "), F.col(notes))


def rate_card_with_objects(
    objects: DataFrame, card: DataFrame, overheads: DataFrame
) -> DataFrame:
    """The displayed card with the number of objects each rate prices (overheads: all of them)."""
    usage = rate_usage(objects, card).select(
        F.col("object_type").alias("Object Type"),
        F.col("complexity_level").alias("Complexity"),
        F.col("transpilability_status").alias("Status"),
        F.col("objects").alias("Objects"),
    )
    everything = usage.agg(F.sum("Objects")).scalar()
    keys = ["Object Type", "Complexity", "Status"]
    return (
        _card_rows(card, overheads)
        .join(usage, keys, "left")
        .withColumn("Objects", F.coalesce("Objects", everything))
    )


def migration_summary(inventory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Inventory with outcomes under display names."""
    return assessment_rows(inventory, outcomes).select(
        F.col("platform").alias("Platform"),
        F.col("file_name").alias(OBJECT),
        F.col("job_type").alias("Job Type"),
        F.col("categorization").alias("Complexity"),
        F.col("included").alias("Included"),
        "number_of_nodes",
        F.col("engine").alias("Engine"),
        F.col("model").alias("Model"),
        F.col("transpiled").cast("string").alias(TRANSPILED),
        F.col("failure_reason").alias("Failure Reason"),
    )


def _summary_view(summary: DataFrame) -> MetricView:
    return MetricView(
        summary,
        dimensions={name: F.col(f"`{name}`") for name in summary.columns},
        measures={
            "Objects": DistinctCount(OBJECT),
            "Transpilable": DistinctCount(OBJECT, F.col(TRANSPILED) == "true"),
            RATE: Percent("Transpilable", "Objects"),
        },
    )


def objects_by(summary: DataFrame, *fields: str) -> DataFrame:
    """Different objects per value of the fields."""
    return _summary_view(summary).query(["Objects"], by=fields)


def transpilability(summary: DataFrame, *fields: str) -> DataFrame:
    """Share of objects converted, over all or per value of the fields."""
    return _summary_view(summary).query([RATE], by=fields)


def object_inventory(summary: DataFrame) -> DataFrame:
    """The inventory table: each different row once."""
    return summary.select(
        OBJECT, "Platform", "Complexity", "Engine", "Model", TRANSPILED, "Failure Reason"
    ).distinct()


def effort_by(estimate: DataFrame, *fields: str, where: Column | None = None) -> DataFrame:
    """Man-days summed per value of the fields."""
    view = MetricView(
        estimate,
        dimensions={name: F.col(name) for name in estimate.columns},
        measures={"Effort (MD)": Total(man_days(), "double")},
    )
    return view.query(["Effort (MD)"], by=fields, where=where)


def effort_of_profiles(estimate: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Man-days of the named profiles, one row per profile that has any."""
    return effort_by(estimate, "profile", where=F.col("profile").isin(*profiles))


def effort_without_overhead(estimate: DataFrame) -> DataFrame:
    """Man-days by status and object type, overhead rows left out."""
    return effort_by(
        estimate,
        "transpilability_status",
        "object_type",
        where=~F.col("object_type").isin(V.OVERHEAD_LABEL),
    )


def planning_detail(estimate: DataFrame) -> DataFrame:
    """Man-days at the grain of the planning table."""
    return effort_by(
        estimate,
        "object_name",
        "object_type",
        "complexity_level",
        "transpilability_status",
        "profile",
    )
