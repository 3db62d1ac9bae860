"""Spreading of small inputs with heavy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES_PER_CORE = 32 * 1024 * 1024
BYTES_PER_TASK = 2 * 1024 * 1024


def spread(df: DataFrame, *keys: str, bytes_per_core: int = BYTES_PER_CORE) -> DataFrame:
    """Give every core a share of an input that comes in too few partitions, in tasks of bounded size.

    Splitting and cleaning texts costs far more per byte than reading them, so a small input that
    sits in one file is hashed out by ``keys`` first: to as many tasks as there are cores, and to more where
    a task would get over ``BYTES_PER_TASK``, so that tasks do not grow with the input. An input that is estimated to fill the cores
    anyway is left alone: it already comes in many partitions, and moving it would cost a shuffle of
    the whole text.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * bytes_per_core:
        return df
    return df.repartition(max(cores, -(-size // BYTES_PER_TASK)), *keys)
