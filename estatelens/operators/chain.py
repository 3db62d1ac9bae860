"""An ordered chain of tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

State = dict[str, object]
Step = tuple[str, Callable[[State], State | None]]


def run_chain(
    steps: Sequence[Step],
    state: State | None = None,
    store: str | None = None,
    spark: SparkSession | None = None,
) -> State:
    """Run named steps one after the other; what a step returns is added to the state.

    A failing step stops the chain and is named in the error. With ``store``, a folder that all executors
    share, the tables a step returns are written there and read from there by later steps. A chain that
    starts again with the same folder finds the steps that ended and goes on at the first that did not; what
    such a step has written in part is written anew. Names of steps must differ then, and a stored step
    returns DataFrames only.
    """
    if store and len({name for name, _ in steps}) < len(steps):
        raise ValueError("stored steps need names of their own")
    if store and spark is None:
        raise ValueError("a stored chain needs the session")
    state = dict(state or {})
    for name, step in steps:
        try:
            found = _stored(spark, f"{store}/{name}") if store else None
            if found is None:
                found = step(state) or {}
                if store:
                    found = _store(spark, f"{store}/{name}", found)
            state.update(found)
        except Exception as error:
            raise RuntimeError(f"step {name!r} failed") from error
    return state


def _store(spark: SparkSession, folder: str, tables: State) -> State:
    """Write the tables of a step, and last of all the list of them."""
    for key, table in tables.items():
        if not isinstance(table, DataFrame):
            raise TypeError(f"{key!r} is no DataFrame")
        table.write.mode("overwrite").parquet(f"{folder}/{key}")
    listed = [(key, table.schema.json()) for key, table in tables.items()]
    spark.createDataFrame(listed, "key string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_list")
    return _stored(spark, folder)


def _stored(spark: SparkSession, folder: str) -> State | None:
    """The tables of a step that ended, or None."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_list/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return None
    listed = spark.read.schema("key string, schema string").parquet(f"{folder}/_list").collect()  # one row a table
    return {r["key"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/{r['key']}") for r in listed}
