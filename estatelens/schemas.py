"""Declared schemas of every relation that is stored. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in fields.items()])


_S, _L, _B, _D, _I = StringType(), LongType(), BooleanType(), DoubleType(), IntegerType()

SCRIPTS = _struct(path=_S, text=_S)
PACKAGES = _struct(path=_S, xml=_S)
OBJECTS = _struct(
    path=_S, pos=_I, name=_S, object_type=_S, nodes=_L, complexity=_S, source=_S, source_file=_S
)
JOB_DETAILS = _struct(
    platform=_S, file_name=_S, job_type=_S, categorization=_S, number_of_nodes=_L, included=_S
)
FUNCTIONS = _struct(function_name=_S, call_count=_L, platform=_S)
TRANSFORMATIONS = _struct(
    transformation_type=_S, occurrences=_L, jobs_count=_L, supported=_S, component_level=_S
)
SQL_STATEMENTS = _struct(
    package_name=_S, node=_S, complexity=_S, connection_type=_S, length=_L, sql_text=_S
)
CONVERSION_RESULTS = _struct(
    file_name=_S,
    file_type=_S,
    engine=_S,
    model=_S,
    success_count=_L,
    error_count=_L,
    transpiled=_B,
    failure_reason=_S,
    transpilation_scope=_S,
    output_file=_S,
)
EFFORT_HYPOTHESIS = _struct(
    object_type=_S,
    complexity_level=_S,
    transpilability_status=_S,
    effort_md_per_unit=_D,
    profile=_S,
    notes=_S,
)
OVERHEAD_HYPOTHESIS = _struct(profile=_S, rate=_D, notes=_S)
CLEANING_STATS = _struct(path=_S, with_clauses=_L, statistics=_L, indexes=_L, varchar_max=_L)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, typed nulls for what is missing.

    Columns the schema does not know are dropped. A column that is all null keeps its declared
    type instead of turning into a void column that later readers refuse.
    """
    present = {name.lower(): name for name in df.columns}

    def column(field: StructField) -> Column:
        source = present.get(field.name.lower())
        value = F.col(f"`{source}`") if source else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])
