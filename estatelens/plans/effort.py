"""Effort in man-days: inventory, outcomes and a rate card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens.session import durable

RATE_KEYS = ["object_type", "complexity_level", "transpilability_status"]
ESTIMATE_COLUMNS = [
    "object_name",
    "object_type",
    "complexity_level",
    "transpilability_status",
    "platform",
    "engine",
    "model",
    "profile",
    "effort_md",
]


def man_days(column: str | Column = "effort_md") -> Column:
    """Man-days as a decimal, so that a distributed sum does not depend on the row order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,6)")


def rate_keys() -> list[Column]:
    """The three keys of the rate card, from inventory and outcome columns.

    An object without an outcome counts as not transpilable here (the metrics count it as
    transpilable; both readings are kept).
    """
    package = F.col("platform") == V.PLATFORM_PACKAGE
    level = F.when(F.col("categorization") == "HIGH", "Transformation").otherwise("Orchestration")
    return [
        F.when(package, "SSIS Component").otherwise("SQL Statement").alias("object_type"),
        F.when(package, level).otherwise(F.col("categorization")).alias("complexity_level"),
        F.when(F.col("transpiled"), "transpilable").otherwise("not_transpilable").alias(
            "transpilability_status"
        ),
    ]


def file_effort(inventory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per object with the three keys of the rate card."""
    found = outcomes.select("file_name", "engine", "model", "transpiled")
    return inventory.join(found, "file_name", "left").select(
        F.col("file_name").alias("object_name"), *rate_keys(), "platform", "engine", "model"
    )


def with_effort(objects: DataFrame, card: DataFrame) -> DataFrame:
    """Objects priced by the card. An object whose keys are not on the card is not in the result."""
    rates = card.select(*RATE_KEYS, "profile", F.col("effort_md_per_unit").alias("effort_md"))
    return objects.join(rates, RATE_KEYS).select(*ESTIMATE_COLUMNS)


def unpriced(objects: DataFrame, card: DataFrame) -> DataFrame:
    """The objects ``with_effort`` leaves out."""
    return objects.join(card.select(*RATE_KEYS), RATE_KEYS, "left_anti")


def overhead(priced: DataFrame, overheads: DataFrame) -> DataFrame:
    """One row per overhead profile: its share of the development total, two decimals.

    The total is a scalar subquery, so no row of the estimate is paired with anything.
    """
    total = priced.agg(F.sum(man_days()).alias("total")).scalar()
    label, missing = F.lit(V.OVERHEAD_LABEL), F.lit(None).cast("string")
    return overheads.select(
        label.alias("object_name"),
        label.alias("object_type"),
        F.col("profile").alias("complexity_level"),
        missing.alias("transpilability_status"),
        missing.alias("platform"),
        missing.alias("engine"),
        missing.alias("model"),
        "profile",
        F.round(total * F.col("rate").cast("decimal(9,6)"), 2).cast("double").alias("effort_md"),
    )


def effort_estimate(
    inventory: DataFrame, outcomes: DataFrame, card: DataFrame, overheads: DataFrame
) -> DataFrame:
    """Priced objects followed by the overhead rows.

    Both the rows and their total are needed, so the priced objects are stored in the checkpoint folder:
    inventory, outcomes and card meet once, and the total reads one column of what is stored.
    """
    priced = durable(with_effort(file_effort(inventory, outcomes), card))
    return priced.unionByName(overhead(priced, overheads))


def with_overheads(total: str | Column, rates: str | Column) -> Column:
    """A development total with its overheads on top, each rounded to two decimals as in the estimate.

    ``rates`` is the array of ``overhead_rates``.
    """
    total = (F.col(total) if isinstance(total, str) else total).cast("decimal(28,6)")
    shares = F.transform(rates, lambda rate: F.round(total * rate, 2).cast("double").cast("decimal(18,6)"))
    return F.aggregate(shares, total, lambda so_far, share: (so_far + share).cast("decimal(28,6)"))


def overhead_rates(overheads: DataFrame) -> Column:
    """The rates of the overhead card, one per profile, as an array."""
    return overheads.agg(F.collect_list(F.col("rate").cast("decimal(9,6)"))).scalar()


def rate_usage(objects: DataFrame, card: DataFrame) -> DataFrame:
    """The rate card with the objects each rate prices; a rate nothing uses shows zero.

    Objects are counted by key before they meet the card, so the join sees a handful of rows.
    """
    used = objects.groupBy(*RATE_KEYS).agg(F.count("*").alias("objects"))
    return card.join(used, RATE_KEYS, "left").select(
        *RATE_KEYS,
        "effort_md_per_unit",
        "profile",
        F.coalesce("objects", F.lit(0)).cast("bigint").alias("objects"),
        (man_days("effort_md_per_unit") * F.coalesce("objects", F.lit(0)))
        .cast("double")
        .alias("effort_md"),
    )


def uplift(objects: DataFrame, card: DataFrame) -> DataFrame:
    """Per type and complexity: how much dearer a manual rewrite is, and what it costs in all."""
    pair = ["object_type", "complexity_level"]
    rewrite = F.col("transpilability_status") == "not_transpilable"
    usage = rate_usage(objects, card)
    rate = F.col("effort_md_per_unit")
    return (
        usage.groupBy(*pair)
        .agg(
            F.max(F.when(~rewrite, rate)).alias("base_md"),
            F.max(F.when(rewrite, rate)).alias("rewrite_md"),
            F.sum(F.when(rewrite, F.col("objects")).otherwise(0)).alias("rewrites"),
        )
        .select(
            *pair,
            F.round((man_days("rewrite_md") / man_days("base_md")), 4).cast("double").alias("ratio"),
            "rewrites",
            ((man_days("rewrite_md") - man_days("base_md")) * F.col("rewrites"))
            .cast("double")
            .alias("extra_md"),
        )
    )
