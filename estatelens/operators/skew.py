"""Joins that stay even when one key holds a large share of the rows.

A join of two stored relations needs none of this: adaptive execution splits its skewed partitions.
It cannot do so where one side comes straight out of an aggregation on the join keys, because that
side is not shuffled again. ``spread_join`` is for those: lookups, updates and merges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 4096
SHARE = 0.01
SALTS = 64

_HOWS = ("inner", "left", "left_semi", "left_anti")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def will_broadcast(df: DataFrame) -> bool:
    """Is the relation small enough, by its estimate, for Spark to broadcast it on its own?"""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(df) <= int(limit)


def _row_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns that tell rows apart: the keys and the narrow columns, all if there are no narrow ones."""
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    hashable = [f for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    narrow = [f.name for f in hashable if not isinstance(f.dataType, wide) and f.name not in keys]
    return [*keys, *(narrow or [f.name for f in hashable if f.name not in keys])]


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    sample: int = SAMPLE,
    share: float = SHARE,
) -> DataFrame:
    """One row: the hashes of the keys that hold more than ``share`` of ``df``, 1/share at most.

    They are read off the ``sample`` rows with the smallest hash, an even sample of fixed size that
    needs no shuffle. A key it misses or adds by chance changes how rows spread, never a result.
    """
    few = (
        df.select(F.xxhash64(*keys).alias("k"), F.xxhash64(*row).alias("h"))
        .orderBy("h", "k")
        .limit(sample)
    )
    counts = few.groupBy("k").agg(F.count("*").alias("n"))
    size = counts.agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("k", "n")).alias("counts")
    )
    return size.select(
        F.transform(
            F.filter("counts", lambda c: c["n"] > F.col("total") * F.lit(share)), lambda c: c["k"]
        )
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    salted: bool | None = None,
) -> DataFrame:
    """Join on equal ``keys`` where a key may hold any share of ``left``.

    A right side that Spark broadcasts by its size needs nothing. Otherwise rows of hot keys are
    dealt out over ``salts`` by a hash of the row, and only the right rows of those keys are repeated
    for every salt; all other rows keep salt 0. Each left row has one salt, so every pair of rows
    meets exactly once, and the result is that of the plain join. A salt is a hash of content, never a
    random number, so a task that runs again deals its rows the same way. Rows that are copies of each
    other share a salt; both sides are plain shuffles here, so adaptive splitting still applies to them.
    """
    if how not in _HOWS:
        raise ValueError(f"how must be one of {_HOWS}, not {how!r}")
    keys = list(keys)
    if salted is None:
        salted = not will_broadcast(right)
    if not salted:
        return left.join(right, keys, how)
    row = _row_columns(left, keys)
    hot = hot_keys(left, keys, row).scalar()

    def is_hot() -> Column:
        return F.array_contains(hot, F.xxhash64(*[F.col(k) for k in keys]))

    dealt = F.pmod(F.xxhash64(F.lit(1), *[F.col(c) for c in row]), F.lit(salts)).cast("int")
    every = F.when(is_hot(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("_salt", F.when(is_hot(), dealt).otherwise(F.lit(0)))
        .join(right.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how)
        .drop("_salt")
    )
