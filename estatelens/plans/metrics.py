"""Metric views: named dimensions and measures, re-aggregated at whatever grain is asked.

A measure is never averaged from a finer result; each query goes back to the rows. Distinct counts
are taken in two steps: one row per (dimensions, key) with the largest flag, then a sum. That needs
one shuffle with map-side combine whatever the number of filtered distinct counts, and no hot
dimension value ever gathers its keys in one task. Where a query counts several keys, each row goes on
once per key, with that key's flags alone; sums and averages ride on the first of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.plans.effort import (
    RATE_KEYS,
    effort_estimate,
    man_days,
    overhead_rates,
    rate_keys,
    with_overheads,
)


@dataclass(frozen=True)
class DistinctCount:
    """Number of different values of ``key`` among rows where ``where`` holds."""

    key: str
    where: Column | None = None


@dataclass(frozen=True)
class Total:
    """Sum of an exact (integer or decimal) expression."""

    value: Column
    as_type: str = "bigint"


@dataclass(frozen=True)
class Mean:
    """Average over rows of an exact expression."""

    value: Column


@dataclass(frozen=True)
class Percent:
    """``100 * part / whole`` of two other measures, null where the whole is zero."""

    part: str
    whole: str


Measure = DistinctCount | Total | Mean | Percent


class MetricView:
    """A relation with dimensions and measures defined once."""

    def __init__(
        self, source: DataFrame, dimensions: dict[str, Column], measures: dict[str, Measure]
    ):
        self.source = source
        self.dimensions = dimensions
        self.measures = measures

    def query(
        self, measures: Iterable[str], by: Iterable[str] = (), where: Column | None = None
    ) -> DataFrame:
        """The measures at the grain of ``by``; ``where`` is a predicate over source columns."""
        wanted, by = list(measures), list(by)
        base = [name for name in self._closure(wanted) if not isinstance(self.measures[name], Percent)]
        rows = self.source if where is None else self.source.filter(where)
        keys = list(
            dict.fromkeys(
                m.key for m in (self.measures[n] for n in base) if isinstance(m, DistinctCount)
            )
        )
        rows = rows.select(
            *[self.dimensions[name].alias(name) for name in by],
            *[F.col(key).alias(f"_key{k}") for k, key in enumerate(keys)],
            *[c for i, name in enumerate(base) for c in self._inputs(i, self.measures[name])],
        )
        if keys:
            rows, combined = self._per_key(rows, keys, base, by)
            rows = rows.groupBy(*[f"`{n}`" for n in by], *combined).agg(
                *[c for i, n in enumerate(base) for c in self._first(i, self.measures[n])]
            )
        final = [c for i, n in enumerate(base) for c in self._second(i, n, bool(keys))]
        grouped = rows.groupBy(*[f"`{n}`" for n in by]).agg(*final)
        done = {n: self._column(n) for n in wanted}
        return grouped.select(*[F.col(f"`{n}`") for n in by], *[c.alias(n) for n, c in done.items()])

    def _per_key(
        self, rows: DataFrame, keys: list[str], base: list[str], by: list[str]
    ) -> tuple[DataFrame, list[str]]:
        """Each row once per key, the other keys null; and the columns that tell the keys' values apart."""
        names = [f"_key{k}" for k in range(len(keys))]
        if len(keys) == 1:
            return rows, names
        rows = rows.withColumn("_at", F.explode(F.array(*[F.lit(k) for k in range(len(keys))])))

        def rides_on(name: str) -> int:
            measure = self.measures[name]
            return keys.index(measure.key) if isinstance(measure, DistinctCount) else 0

        kept = [F.when(F.col("_at") == k, F.col(name)).alias(name) for k, name in enumerate(names)]
        values = [F.when(F.col("_at") == rides_on(n), F.col(f"_v{i}")).alias(f"_v{i}") for i, n in enumerate(base)]
        return rows.select(*[f"`{n}`" for n in by], "_at", *kept, *values), ["_at", *names]

    # -- one measure through the stages

    def _closure(self, names: list[str]) -> list[str]:
        out: list[str] = []
        for name in names:
            measure = self.measures[name]
            parts = [measure.part, measure.whole] if isinstance(measure, Percent) else [name]
            out += [part for part in parts if part not in out]
        return out

    def _inputs(self, i: int, measure: Measure) -> list[Column]:
        if isinstance(measure, DistinctCount):
            holds = F.lit(True) if measure.where is None else F.coalesce(measure.where, F.lit(False))
            counted = F.col(measure.key).isNotNull() & holds
            return [F.when(counted, 1).otherwise(0).alias(f"_v{i}")]
        return [measure.value.alias(f"_v{i}")]

    @staticmethod
    def _first(i: int, measure: Measure) -> list[Column]:
        if isinstance(measure, DistinctCount):
            return [F.max(f"_v{i}").alias(f"_v{i}")]
        out = [F.sum(f"_v{i}").alias(f"_v{i}")]
        if isinstance(measure, Mean):
            out.append(F.count(f"_v{i}").alias(f"_n{i}"))
        return out

    def _second(self, i: int, name: str, combined: bool) -> list[Column]:
        measure = self.measures[name]
        if isinstance(measure, Mean):
            count = F.sum(f"_n{i}") if combined else F.count(f"_v{i}")
            return [(F.sum(f"_v{i}").cast("double") / count).alias(f"_m_{name}")]
        as_type = measure.as_type if isinstance(measure, Total) else "bigint"
        value = F.sum(f"_v{i}").cast(as_type)
        if isinstance(measure, DistinctCount):
            value = F.coalesce(value, F.lit(0))
        return [value.alias(f"_m_{name}")]

    def _column(self, name: str) -> Column:
        measure = self.measures[name]
        if isinstance(measure, Percent):
            part, whole = F.col(f"`_m_{measure.part}`"), F.col(f"`_m_{measure.whole}`")
            return part.cast("double") * 100 / F.nullif(whole, F.lit(0))
        return F.col(f"`_m_{name}`")


def assessment_rows(inventory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Inventory with outcomes; an object without an outcome counts as transpilable."""
    found = outcomes.select(
        "file_name", "engine", "model", "transpiled", "failure_reason", "success_count"
    )
    return inventory.join(found, "file_name", "left").withColumn(
        "transpiled", F.coalesce("transpiled", F.lit(True))
    )


def assessment_metrics(inventory: DataFrame, outcomes: DataFrame) -> MetricView:
    """Inventory and conversion outcomes, one row per file."""
    complexity = F.col("categorization")
    return MetricView(
        assessment_rows(inventory, outcomes),
        dimensions={
            "Platform": F.col("platform"),
            "File Name": F.col("file_name"),
            "Job Type": F.col("job_type"),
            "Complexity": complexity,
            "Included": F.col("included"),
            "Engine": F.col("engine"),
            "Model": F.col("model"),
            "Transpiled": F.col("transpiled").cast("string"),
            "Failure Reason": F.col("failure_reason"),
        },
        measures={
            "Total Files": DistinctCount("file_name"),
            "Transpilable Files": DistinctCount("file_name", F.col("transpiled")),
            "Not Transpilable Files": DistinctCount("file_name", ~F.col("transpiled")),
            "Transpilability Rate": Percent("Transpilable Files", "Total Files"),
            "Low Complexity Files": DistinctCount("file_name", complexity == "LOW"),
            "Medium Complexity Files": DistinctCount("file_name", complexity == "MEDIUM"),
            "High Complexity Files": DistinctCount("file_name", complexity == "HIGH"),
            "Avg Nodes per File": Mean(F.col("number_of_nodes")),
            "Total Statements Converted": Total(F.col("success_count")),
        },
    )


def effort_metrics(
    inventory: DataFrame, outcomes: DataFrame, card: DataFrame, overheads: DataFrame
) -> MetricView:
    """The effort estimate with its overhead rows."""
    names = [
        "object_name",
        "object_type",
        "complexity_level",
        "transpilability_status",
        "platform",
        "engine",
        "model",
        "profile",
    ]
    return MetricView(
        effort_estimate(inventory, outcomes, card, overheads),
        dimensions={name: F.col(name) for name in names},
        measures={"Effort (MD)": Total(man_days(), "double")},
    )


def headline_metrics(inventory: DataFrame, outcomes: DataFrame, card: DataFrame) -> MetricView:
    """Files and their man-days without overheads: inventory, outcomes and card met once."""
    found = outcomes.select("file_name", "transpiled")
    objects = inventory.join(found, "file_name", "left").select(
        "file_name", F.coalesce("transpiled", F.lit(True)).alias("transpiled"), *rate_keys()
    )
    rates = card.select(*RATE_KEYS, man_days("effort_md_per_unit").alias("effort_md"))
    return MetricView(
        objects.join(rates, RATE_KEYS, "left"),
        dimensions={},
        measures={
            "Total Files": DistinctCount("file_name"),
            "Transpilable Files": DistinctCount("file_name", F.col("transpiled")),
            "Transpilability Rate": Percent("Transpilable Files", "Total Files"),
            "Development (MD)": Total(F.col("effort_md"), "decimal(28,6)"),
        },
    )


def kpi_sheet(
    inventory: DataFrame, outcomes: DataFrame, card: DataFrame, overheads: DataFrame
) -> DataFrame:
    """Three headline figures as (metric, value) rows of text, from one pass over the joined rows."""
    figures = headline_metrics(inventory, outcomes, card).query(
        ["Total Files", "Transpilability Rate", "Development (MD)"]
    )
    # a column of its own: a subquery may not stand inside a higher-order function
    figures = figures.withColumn("_rates", overhead_rates(overheads))
    shown = {
        "Total files": F.col("Total Files"),
        "Transpilability %": F.round("Transpilability Rate", 1).cast("decimal(18,1)"),
        "Total effort (MD)": with_overheads("Development (MD)", "_rates").cast("decimal(18,2)"),
    }
    lines = [F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in shown.items()]
    return figures.select(F.inline(F.array(*lines)))
