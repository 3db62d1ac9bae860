"""Packages: components, support, embedded SQL, edges and parameters out of ``(path, xml)``.

Per-package figures are made inside the row; only totals over packages are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from estatelens import fixed_values as V
from estatelens.functions import scalars as S
from estatelens.functions import text as X
from estatelens.functions import xml as M
from estatelens.operators.partitioning import spread
from estatelens.session import durable
from estatelens.sources.literals import literal_relation

ROOT_TYPE = "Package"
POLICY = StructType(
    [
        StructField("transformation_type", StringType()),
        StructField("is_supported", BooleanType()),
    ]
)

REACH_KEYS = ["path", "src", "dst"]
REACH = "path string, src string, dst string, hops int"
#: Constraints of a package up to which it is walked in one place, and pairs handed on together.
EDGES_AT_ONCE = 500
ROWS_AT_ONCE = 10_000


def _types(c: Column) -> Column:
    """Types of all tasks and components in document order, as written."""
    return F.regexp_extract_all(c, F.lit(V.COMPONENT_ATTRIBUTE), F.lit(1))


def _short(c: Column) -> Column:
    return F.replace(c, F.lit(V.COMPONENT_PREFIX), F.lit(""))


def components(packages: DataFrame) -> DataFrame:
    """One row per task and component in document order; the package itself is none."""
    inner = F.filter(_types(F.col("xml")), lambda t: _short(t) != ROOT_TYPE)
    return packages.select("path", F.posexplode(inner).alias("pos", "raw")).select(
        "path", "pos", _short(F.col("raw")).alias("component_type")
    )


def complexity(packages: DataFrame) -> DataFrame:
    """Nodes per package and the bucket they put it in."""
    inner = F.filter(_types(F.col("xml")), lambda t: _short(t) != ROOT_TYPE)
    return packages.select("path", F.size(inner).cast("bigint").alias("nodes")).withColumn(
        "complexity", X.package_bucket(F.col("nodes"))
    )


def unsupported_types(xml: Column) -> Column:
    """Sorted different component types of a package that need a manual rewrite."""
    listed = F.filter(_types(xml), lambda t: t.isin(*V.UNSUPPORTED_COMPONENTS))
    return F.array_sort(F.array_distinct(F.transform(listed, _short)))


def unsupported(packages: DataFrame) -> DataFrame:
    """Each package with its unsupported components, ``", "`` between them; empty if none."""
    return packages.select(
        "path", F.array_join(unsupported_types(F.col("xml")), ", ").alias("unsupported")
    )


def support_policy(spark: SparkSession, name: str = "documented") -> DataFrame:
    """Which component types count as supported.

    ``documented``: the listed supported and not supported types. ``converter``: every type except
    the listed manual-rewrite ones; loops, sequences and scripts count as supported there.
    """
    if name == "documented":
        rows = [(t, True) for t in V.SUPPORTED_TYPES] + [(t, False) for t in V.NOT_SUPPORTED_TYPES]
    elif name == "converter":
        manual = [t.removeprefix(V.COMPONENT_PREFIX) for t in V.UNSUPPORTED_COMPONENTS]
        named = V.SUPPORTED_TYPES + [t for t in V.NOT_SUPPORTED_TYPES if t not in manual]
        rows = [(t, True) for t in named] + [(t, False) for t in manual]
    else:
        raise ValueError(f"no support policy {name!r}")
    return literal_relation(spark, rows, POLICY)


def transformations(packages: DataFrame, policy: DataFrame) -> DataFrame:
    """Occurrences and packages per component type, with support and level.

    Each package first counts its own types, so what is shuffled is one row per package and type,
    combined before it leaves the task; a type all packages use does not gather in one place.
    """
    per_package = packages.select(
        F.filter(
            F.concat(
                _levelled("ExecutableType", "Control Flow"), _levelled("componentClassID", "Data Flow")
            ),
            lambda t: t["transformation_type"] != ROOT_TYPE,
        ).alias("found")
    ).select(
        F.explode(
            F.transform(
                F.array_distinct("found"),
                lambda t: F.struct(
                    t.alias("t"), F.size(F.filter("found", lambda x: x == t)).alias("n")
                ),
            )
        ).alias("c")
    )
    totals = per_package.groupBy("c.t.transformation_type", "c.t.component_level").agg(
        F.sum("c.n").cast("bigint").alias("occurrences"), F.count("*").alias("jobs_count")
    )
    supported = F.when(F.col("is_supported"), "YES").when(~F.col("is_supported"), "NO")
    return totals.join(policy, "transformation_type", "left").select(
        "transformation_type",
        "occurrences",
        "jobs_count",
        F.coalesce(supported, F.lit("UNKNOWN")).alias("supported"),
        "component_level",
    )


def _levelled(attribute: str, level: str) -> Column:
    """Types named by one attribute, with the level that attribute stands for."""
    return F.transform(
        F.regexp_extract_all("xml", F.lit(attribute + r'="([^"]+)"'), F.lit(1)),
        lambda t: F.struct(
            _short(t).alias("transformation_type"), F.lit(level).alias("component_level")
        ),
    )


def _node_rows(packages: DataFrame) -> DataFrame:
    """One row per task and component: its name, type, and the text up to the next one."""
    rows = packages.select("path", F.posexplode(M.nodes(F.col("xml"))).alias("pos", "chunk"))
    return rows.select(
        "path",
        "pos",
        "chunk",
        F.regexp_extract("chunk", r"""^(<(?:[^>"']|"[^"]*+"|'[^']*+')*+>)""", 1).alias("tag"),
    )


def embedded_sql(packages: DataFrame) -> DataFrame:
    """SQL inside packages: task statements and component commands, one row each."""
    chunk, tag = F.col("chunk"), F.col("tag")
    found = _node_rows(packages).select(
        "path",
        "pos",
        F.coalesce(M.attribute(tag, "DTS:ObjectName"), M.attribute(tag, "name")).alias("named"),
        F.regexp_extract(tag, V.COMPONENT_ATTRIBUTE, 1).alias("raw_type"),
        F.posexplode(
            F.concat(
                F.regexp_extract_all(chunk, F.lit(r'SqlStatementSource="([^"]*+)"'), F.lit(1)),
                F.regexp_extract_all(
                    chunk, F.lit(r'<property name="SqlCommand"[^>]*+>([^<]*+)</property>'), F.lit(1)
                ),
            )
        ).alias("n", "raw_sql"),
        F.regexp_extract(chunk, r'SQLTask:Connection="([^"]*+)"', 1).alias("connection"),
    )
    sql = M.unescape(F.col("raw_sql"))
    return found.select(
        "path",
        "pos",
        "n",
        _short(F.col("raw_type")).alias("node_type"),
        "named",
        "connection",
        sql.alias("sql_text"),
    ).select(
        S.base_name("path").alias("package_name"),
        F.coalesce("named", "node_type").alias("node"),
        X.size_bucket(X.size_score(F.col("sql_text"))).alias("complexity"),
        F.when(F.col("connection") != "", F.col("connection"))
        .otherwise(F.col("node_type"))
        .alias("connection_type"),
        F.length("sql_text").cast("bigint").alias("length"),
        "sql_text",
    )


def data_flow_edges(packages: DataFrame) -> DataFrame:
    """Wires between component ports: ``(path, pos, src, dst)``."""
    return _edges(packages, "path", "startId", "endId")


def precedence_edges(packages: DataFrame) -> DataFrame:
    """Precedence constraints between tasks: ``(path, pos, src, dst)``."""
    return _edges(packages, "DTS:PrecedenceConstraint", "DTS:From", "DTS:To")


def _edges(packages: DataFrame, element: str, start: str, end: str) -> DataFrame:
    tags = packages.select(
        "path", F.posexplode(M.start_tags(F.col("xml"), element)).alias("pos", "tag")
    )
    tag = F.col("tag")
    return tags.select(
        "path", "pos", M.attribute(tag, start).alias("src"), M.attribute(tag, end).alias("dst")
    )


def precedence_reach(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """All pairs of tasks that a chain of constraints connects, with the length of the shortest.

    A package of up to ``at_once`` different constraints is walked where its constraints meet, from each
    task in turn, and none of its pairs is shuffled. Larger ones go by joins, spread over all tasks.
    """
    wired = edges.select(*REACH_KEYS).dropna().groupBy("path").agg(F.collect_set(F.struct("src", "dst")).alias("wires"))
    stored = durable(wired)
    large = stored.where(F.size("wires") > at_once).select("path", F.inline("wires"))
    walked = spread(stored.where(F.size("wires") <= at_once), "path").mapInArrow(_walk, REACH)
    return durable(walked).unionByName(_reach_by_joins(large))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``REACH`` for packages and their constraints, breadth first from every task."""
    rows: list[tuple[str, str, str, int]] = []
    for batch in batches:
        for path, wires in zip(batch.column("path"), batch.column("wires")):
            path, after = path.as_py(), {}
            for wire in wires.as_py():
                after.setdefault(wire["src"], []).append(wire["dst"])
            for start in after:
                hops: dict[str, int] = {}
                reached, steps = [start], 0
                while reached:
                    steps += 1
                    met = dict.fromkeys(task for last in reached for task in after.get(last, ()))
                    reached = [task for task in met if task not in hops]
                    hops.update(dict.fromkeys(reached, steps))
                rows += [(path, start, task, n) for task, n in hops.items()]
                if len(rows) >= ROWS_AT_ONCE:
                    yield _reach_batch(rows)
                    rows = []
    if rows:
        yield _reach_batch(rows)


def _reach_batch(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    path, src, dst, hops = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(path), pa.array(src), pa.array(dst), pa.array(hops, pa.int32())], [*REACH_KEYS, "hops"]
    )


def _reach_by_joins(edges: DataFrame) -> DataFrame:
    """The pairs of different edges ``(path, src, dst)``.

    Path doubling: when all pairs of up to n hops are known, a pair of n + 1 to 2n hops is one of exactly n
    and one of at most n hops. So a chain of 1,000 takes 10 rounds, and a round only joins the longest pairs
    with the others; with none of exactly n hops all are known. Pairs are combined before their shuffle and
    every round is stored, so none is computed again.
    """
    known, longest = edges.withColumn("hops", F.lit(1)), 1
    while not (left := known.where(F.col("hops") == longest)).isEmpty():
        left = left.withColumnRenamed("dst", "_via")
        right = known.select("path", F.col("src").alias("_via"), "dst", F.col("hops").alias("_more"))
        longer = left.join(right, ["path", "_via"]).select(*REACH_KEYS, (F.col("hops") + F.col("_more")).alias("hops"))
        known = durable(known.unionByName(longer).groupBy(*REACH_KEYS).agg(F.min("hops").alias("hops")))
        longest *= 2
    return known


def parameters(packages: DataFrame) -> DataFrame:
    """Parameter bindings of tasks: ``(path, node, pos, parameter, variable, direction)``."""
    rows = _node_rows(packages).select(
        "path",
        M.attribute(F.col("tag"), "DTS:ObjectName").alias("node"),
        F.posexplode(M.start_tags(F.col("chunk"), "SQLTask:ParameterBinding")).alias("pos", "binding"),
    )
    binding = F.col("binding")
    return rows.select(
        "path",
        "node",
        "pos",
        M.attribute(binding, "SQLTask:ParameterName").alias("parameter"),
        M.attribute(binding, "SQLTask:DtsVariableName").alias("variable"),
        M.attribute(binding, "SQLTask:ParameterDirection").alias("direction"),
    )


def to_inventory(packages: DataFrame, key: Column | None = None) -> DataFrame:
    """Packages as inventory rows; ``key`` defaults to the file name."""
    return complexity(packages).select(
        F.lit(V.PLATFORM_PACKAGE).alias("platform"),
        (S.base_name("path") if key is None else key).alias("file_name"),
        F.lit("Package").alias("job_type"),
        F.col("complexity").alias("categorization"),
        F.col("nodes").alias("number_of_nodes"),
        F.lit("YES").alias("included"),
    )


# -- converted code


def count_cells(outputs: DataFrame) -> DataFrame:
    """Spark SQL cells per package over all files written for it, and those files' names."""
    escaped = V.CELL_MARK.replace(".", r"\.").replace("(", r"\(")
    return outputs.groupBy("path").agg(
        F.sum(F.regexp_count("code", F.lit(escaped))).cast("bigint").alias("sql_cells"),
        F.array_join(F.array_sort(F.collect_list("output_file")), ", ").alias("output_files"),
    )
