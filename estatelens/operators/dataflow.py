"""Data-flow components as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatelens.operators.merge import update_from
from estatelens.operators.skew import spread_join
from estatelens.schemas import conform

ERROR_OUTPUT = "error"


def source_query(spark: SparkSession, text: str, args=None, **relations: DataFrame) -> DataFrame:
    """A source defined by a SQL command; ``{name}`` in the text is one of ``relations``."""
    return spark.sql(text, args, **relations)


def destination(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A table after rows were appended to it: columns by name, types of the table, missing ones null."""
    return table.unionByName(conform(rows, table.schema))


# -- row by row


def derive(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Named columns set to expressions, all seeing the input row."""
    return df.withColumns(
        {name: F.expr(e) if isinstance(e, str) else e for name, e in columns.items()}
    )


def output_of(outputs: dict[str, str | Column], default: str = "default") -> Column:
    """The first output whose expression is true, else the default one."""
    name = F.when(F.lit(False), "")
    for output, expression in outputs.items():
        name = name.when(F.expr(expression) if isinstance(expression, str) else expression, output)
    return name.otherwise(default)


def conditional_split(
    df: DataFrame, outputs: dict[str, str | Column], default: str = "default"
) -> dict[str, DataFrame]:
    """One DataFrame per output; each row goes to the first one that matches."""
    tagged = df.withColumn("_output", output_of(outputs, default))
    return {
        name: tagged.filter(F.col("_output") == name).drop("_output")
        for name in [*outputs, default]
    }


def data_convert(df: DataFrame, types: dict[str, str]) -> dict[str, DataFrame]:
    """Columns converted to types; rows with a value that does not convert go to the error output."""
    converted = {c: F.col(c).try_cast(t) for c, t in types.items()}
    bad = reduce(
        lambda a, b: a | b, [F.col(c).isNotNull() & v.isNull() for c, v in converted.items()]
    )
    return {
        "output": df.filter(~bad).withColumns(converted),
        ERROR_OUTPUT: df.filter(bad),
    }


def script_component(
    df: DataFrame, body: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str
) -> DataFrame:
    """Code of the user's own over Arrow batches of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return map(body, batches)

    return df.mapInArrow(run, schema)


# -- several inputs or outputs


def one_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest row of every key: always the same one, and combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    smallest = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return smallest.select(*keys, "_row.*").select(*df.columns)


def lookup(
    df: DataFrame, reference: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> dict[str, DataFrame]:
    """Rows with the looked-up columns (``match``), and the rows without a match (``nomatch``).

    A key that the reference holds several times gives one match. A small reference is broadcast by
    its size; with a large one hot input keys are spread.
    """
    found = one_row_per_key(reference.select(*keys, *columns), keys)
    return {
        "match": spread_join(df, found, keys).select(*df.columns, *columns),
        "nomatch": spread_join(df, found.select(*keys), keys, "left_anti"),
    }


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two inputs on equal keys: inner, left or full. A null key matches nothing.

    A full outer join cannot deal a hot key out: each side's rows of it are one task. Here the left rows meet
    the right ones in a left join that spreads hot left keys over salts, and the right rows without a partner
    follow from an anti join with the left side's different keys, in which hot right keys are spread.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"a merge join is inner, left or full, not {how!r}")
    keys = list(keys)
    joined = spread_join(left, right, keys, "left" if how == "full" else how)
    if how != "full":
        return joined
    rest = spread_join(right, left.select(*keys).distinct(), keys, "left_anti")
    return joined.unionByName(rest, allowMissingColumns=True)


def union_all(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def multicast(df: DataFrame, outputs: int) -> list[DataFrame]:
    """The same rows for several consumers."""
    return [df] * outputs


def sort(df: DataFrame, *keys: str, remove_duplicates: bool = False) -> DataFrame:
    """Rows in key order (``-name`` descending), or one row per key.

    The other columns break ties, so the order is total: equal keys, however many, still spread over
    the sorted ranges.
    """
    names = [k.lstrip("-") for k in keys]
    if remove_duplicates:
        df = one_row_per_key(df, names)
    order = [F.col(k[1:]).desc() if k.startswith("-") else F.col(k) for k in keys]
    return df.orderBy(*order, *[F.col(c) for c in df.columns if c not in names])


def aggregate(df: DataFrame, by: Sequence[str], **measures: str | Column) -> DataFrame:
    """Group and aggregate."""
    return df.groupBy(*by).agg(
        *[(F.expr(m) if isinstance(m, str) else m).alias(name) for name, m in measures.items()]
    )


def row_count(df: DataFrame, name: str = "row_count") -> tuple[DataFrame, Observation]:
    """The rows unchanged, and an observation that holds their number once they have been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def command_as_update(
    target: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    assign: dict[str, str],
    order: Sequence[str],
) -> DataFrame:
    """A statement run once per row, done set-wise: of several rows for a key the last one holds."""
    values = list(dict.fromkeys(assign.values()))
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in values if c not in order])).alias("_l"))
    return update_from(target, last.select(*keys, *[F.col("_l")[c].alias(c) for c in values]), keys, assign)


def row_sampling(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows of the whole input, the same ones every time: those with the smallest key hash."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *[F.col(k) for k in keys]).limit(n)


def for_each(
    loop: DataFrame, rows: DataFrame, on: Sequence[str], by: Sequence[str] = (), **measures: str
) -> DataFrame:
    """A loop over a relation, done as a join: the measures of the rows of every loop element.

    Rows are combined per element before the join. An element without rows keeps null measures.
    """
    totals = aggregate(rows, [*on, *by], **measures)
    return loop.join(totals, list(on), "left")
