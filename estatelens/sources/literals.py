"""Literal relations: the rate card and the support lists.

They are handed over as Arrow tables, which Spark plans as local relations with a known size, so the
optimizer can broadcast them on its own size check.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from estatelens import fixed_values as V
from estatelens import schemas

_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def literal_relation(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """Rows of constants with a declared schema."""
    fields = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema.fields]
    columns = [
        pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=pa.schema(fields)))


def rate_card(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Man-days per unit by object type, complexity and status."""
    return literal_relation(spark, rows or V.UNIT_RATES, schemas.EFFORT_HYPOTHESIS)


def overhead_card(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Overhead profiles as a share of the development total."""
    return literal_relation(spark, rows or V.OVERHEAD_RATES, schemas.OVERHEAD_HYPOTHESIS)
