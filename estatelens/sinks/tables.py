"""Table writes on plain Spark tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatelens import schemas
from estatelens.operators.merge import merge
from estatelens.session import durable


def identifier(name: str) -> str:
    """``[dw].[dim_customer]`` or ``dw.dim_customer`` as a quoted Spark name."""
    parts = re.findall(r"\[([^\]]+)\]|([^.\[\]]+)", name)
    return ".".join("`" + (a or b).strip().replace("`", "``") + "`" for a, b in parts)


def _text(value: str) -> str:
    """A text literal; partition values take no parameter marks."""
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
    return f"'{escaped}'"


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {identifier(name)}")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {identifier(table)}")


def truncate(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {identifier(table)}")


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(identifier(table))


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def create(
    spark: SparkSession, table: str, columns: str, partition_by: str | None = None, folder: str | None = None
) -> None:
    """A table from a column list with types, NOT NULL and DEFAULT; its files in ``folder`` if one is named.

    Key constraints cannot be declared on these tables; ``operators.merge.duplicate_keys`` checks them.
    """
    partition = f" PARTITIONED BY ({partition_by})" if partition_by else ""
    place = f" LOCATION {_text(folder)}" if folder else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {identifier(table)} ({columns}) USING parquet{partition}{place}")


def overwrite(df: DataFrame, table: str) -> None:
    """Replace a table and its schema. An empty result empties the table."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(identifier(table))


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(identifier(table))


def replace_conformed(df: DataFrame, table: str, schema: StructType) -> None:
    """Replace a table by rows brought to a declared schema."""
    overwrite(schemas.conform(df, schema), table)


def overwrite_in_place(df: DataFrame, table: str) -> None:
    """Replace a table by a result computed from it.

    The result is first written to the shared checkpoint folder. Spark then no longer reads the table
    it is about to replace, and a failure while replacing leaves the result on disk.
    """
    overwrite(durable(df), table)


def replace_partition(df: DataFrame, table: str, column: str, value: str) -> None:
    """Replace one partition; an empty result empties it, all others stay."""
    spark = df.sparkSession
    rest = [c for c in spark.table(identifier(table)).columns if c != column]
    rows = df.select(*rest)
    spark.sql(
        f"INSERT OVERWRITE TABLE {identifier(table)} PARTITION ({identifier(column)} = {_text(value)}) "
        "SELECT * FROM {rows}",
        rows=rows,
    )


def merge_into(
    source: DataFrame,
    table: str,
    keys: Sequence[str],
    partition: str,
    update: Sequence[str] | None = None,
    insert: Sequence[str] | None = None,
) -> list:
    """Merge ``source`` into a stored table that is partitioned by ``partition``; returns the partitions rewritten.

    Only partitions that hold a matched row, or get a row, are read whole and written; to find them, keys and
    partitions of the table are looked through. The new rows are written to the shared checkpoint folder
    first and then replace their partitions in one job, which moves them into place as its last step: a
    failure before that leaves the table as it was, and a merge that is run again gives the same table.
    A matched row whose partition changes moves there. Rows whose partition is null stay as they are; a merge
    that would change one is refused. A key that occurs twice in the source raises; a null
    key matches nothing and is inserted.
    """
    spark = source.sparkSession
    stored = read(spark, table)
    source = durable(source)
    wanted = source.select(*keys).dropna().distinct()
    # as many values as partitions are touched, which is what the table's catalog has to hold anyway
    matched = stored.select(*keys, partition).join(wanted, list(keys), "left_semi")
    named = matched.select(partition).union(source.select(F.col(partition).cast(stored.schema[partition].dataType)))
    touched = [r[0] for r in named.distinct().collect()]
    if not touched:
        return []
    if None in touched:
        raise ValueError(f"a merge into {table} would change rows without a {partition}")
    here = F.col(partition).isin(touched)
    new = durable(merge(stored.where(here), source, keys, update, insert))
    emptied = [v for v in touched if v not in {r[0] for r in new.select(partition).distinct().collect()}]
    mode, dynamic = "spark.sql.sources.partitionOverwriteMode", "dynamic"
    before = spark.conf.get(mode)
    spark.conf.set(mode, dynamic)
    try:
        new.select(*stored.columns).write.mode("overwrite").insertInto(identifier(table))
    finally:
        spark.conf.set(mode, before)
    for value in emptied:
        replace_partition(new.limit(0), table, partition, value)
    return sorted(touched)


def insert_select(df: DataFrame, table: str) -> None:
    """Insert rows by column name; columns the rows lack get their default."""
    names = ", ".join(identifier(c) for c in df.columns)
    df.sparkSession.sql(
        f"INSERT INTO {identifier(table)} ({names}) SELECT {names} FROM {{rows}}", rows=df
    )


def insert_values(spark: SparkSession, table: str, values: dict) -> None:
    """Insert one row of bound parameters."""
    names = ", ".join(identifier(c) for c in values)
    marks = ", ".join(f":{c}" for c in values)
    spark.sql(f"INSERT INTO {identifier(table)} ({names}) VALUES ({marks})", args=values)


def load(df: DataFrame, destination: str) -> int:
    """Append to a destination given as a bracketed name; returns the rows written.

    The rows are counted while they are written, without another pass.
    """
    seen = Observation()
    append(df.observe(seen, F.count(F.lit(1)).alias("rows")), destination)
    return seen.get["rows"]


def truncate_load(df: DataFrame, table: str) -> int:
    """Replace the rows of a stage; returns the rows written.

    One overwrite that keeps the table's columns: rows are made before old ones go, so a failure leaves the
    stage as it was, and the rows may come from the stage itself.
    """
    seen = Observation()
    rows = durable(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    columns = read(df.sparkSession, table).columns
    rows.select(*columns).write.mode("overwrite").insertInto(identifier(table))
    return seen.get["rows"]
