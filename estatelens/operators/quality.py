"""Data-quality rules: counts, quarantine and the valid remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, Column]


def rule_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """``(rule, failed_rows)``: all rules counted in one pass, then turned into rows."""
    counts = df.agg(*[F.count_if(p).alias(f"_{i}") for i, p in enumerate(rules.values())])
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("failed_rows"))
        for i, name in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def first_reason(rules: Rules) -> Column:
    """The first rule a row breaks, null if none. A rule that is null for a row is not broken."""
    reason = F.when(F.lit(False), "")
    for name, predicate in rules.items():
        reason = reason.when(predicate, name)
    return reason


def quarantine(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break a rule, with the first one as ``dq_reason``."""
    return df.withColumn("dq_reason", first_reason(rules)).filter(F.col("dq_reason").isNotNull())


def valid(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break no rule: exactly those ``quarantine`` leaves out."""
    return df.filter(first_reason(rules).isNull())
