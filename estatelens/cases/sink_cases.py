"""Queries that write tables and read them back.

Each run makes tables of its own under the shared checkpoint folder. Their files are read by path
afterwards and the names are dropped again; the files stay until that folder is cleared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.cases.base import Cases
from estatelens.cases.views import Inputs
from estatelens.operators import warehouse as W
from estatelens.operators.chain import run_chain
from estatelens.session import ensure_checkpoint_dir
from estatelens.sinks import tables

cases = Cases()


class Scratch:
    """A table made from ``first``, for one query."""

    def __init__(self, t: Inputs, first: DataFrame, partition: str | None = None):
        self.spark = t.spark
        self.name = f"scratch_{uuid.uuid4().hex}"
        self.folder = f"{ensure_checkpoint_dir(t.spark)}/{self.name}"
        writer = first.write.option("path", self.folder)
        (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name)

    def result(self) -> DataFrame:
        """What the table holds now; its name is gone afterwards."""
        schema = tables.read(self.spark, self.name).schema
        tables.drop(self.spark, self.name)
        return self.spark.read.schema(schema).parquet(self.folder)


@cases.add(
    "sink_merge_table",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus <> 'P' THEN 0 - o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus FROM {orders}
UNION ALL SELECT 0 - o_orderkey, 0 - o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey % 10 = 0 AND o_orderkey <> 0 AND o_orderstatus <> 'P'""",
)
def sink_merge_table(t):
    """A stored table after a merge that updates and inserts rows in two of its three partitions."""
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = Scratch(t, orders, "o_orderstatus")
    changed = orders.where("o_orderkey % 10 = 0 AND o_orderstatus <> 'P'").withColumn("o_custkey", -F.col("o_custkey"))
    fresh = changed.where("o_orderkey <> 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    source = changed.unionByName(fresh)
    tables.merge_into(source, stored.name, ["o_orderkey"], "o_orderstatus", update=["o_custkey"])
    return stored.result()


@cases.add(
    "sink_overwrite",
    "SELECT o_orderpriority AS priority, count(*) AS orders FROM {orders} GROUP BY o_orderpriority",
)
def sink_overwrite(t):
    """A table that is replaced, with its schema, by a result computed from itself."""
    stored = Scratch(t, t["orders"].select("o_orderkey", F.col("o_orderpriority").alias("priority")))
    counts = tables.read(t.spark, stored.name).groupBy("priority").agg(F.count("*").alias("orders"))
    rows = tables.durable(counts)
    tables.drop(t.spark, stored.name)
    rows.write.mode("overwrite").option("path", stored.folder).saveAsTable(stored.name)
    return stored.result()


@cases.add(
    "sink_append",
    "SELECT n_nationkey AS id, n_name AS name FROM {nation} UNION ALL SELECT c_custkey, c_name FROM {customer}",
)
def sink_append(t):
    """A table after an append and a load that counts its rows while it writes them."""
    stored = Scratch(t, t["nation"].selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name"))
    customers = t["customer"].selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_name AS name")
    tables.append(customers.where("id % 2 = 0"), stored.name)
    tables.load(customers.where("id % 2 = 1"), f"[{stored.name}]")
    return stored.result()


@cases.add(
    "sink_create_insert",
    """SELECT c_custkey AS id, c_name AS name, 'new' AS state FROM {customer} UNION ALL SELECT -1, 'no one', 'none'""",
)
def sink_create_insert(t):
    """A declared table after INSERT … SELECT, whose missing column takes its default, and INSERT … VALUES."""
    name = f"scratch_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(t.spark)}/{name}"
    tables.create(t.spark, name, "id BIGINT NOT NULL, name STRING, state STRING DEFAULT 'new'", folder=folder)
    tables.insert_select(t["customer"].selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_name AS name"), name)
    tables.insert_values(t.spark, name, {"id": -1, "name": "no one", "state": "none"})
    rows = t.spark.read.schema("id BIGINT, name STRING, state STRING").parquet(folder)
    tables.drop(t.spark, name)
    return rows


@cases.add(
    "sink_replace_partition",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS o_custkey, o_orderstatus FROM {orders}
WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0""",
)
def sink_replace_partition(t):
    """A snapshot table after one of its partitions was made anew."""
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = Scratch(t, orders, "o_orderstatus")
    again = orders.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0").withColumn("o_custkey", F.lit(0).cast(orders.schema["o_custkey"].dataType))
    tables.replace_partition(again, stored.name, "o_orderstatus", "F")
    return stored.result()


def loaded(t: Inputs, old: DataFrame, rows: DataFrame) -> DataFrame:
    """A stage that held ``old``, after truncate and load."""
    stored = Scratch(t, old)
    tables.truncate_load(rows, stored.name)
    return stored.result()


def inserted(t: Inputs, rows: DataFrame) -> DataFrame:
    """An empty table of the rows' columns, after they were inserted by name."""
    stored = Scratch(t, rows.limit(0))
    tables.insert_select(rows, stored.name)
    return stored.result()


@cases.add(
    "sink_audited_load",
    """SELECT 'orders' AS process_name, count(*) AS rows_processed FROM {orders}
UNION ALL SELECT 'orders read back', count(*) FROM {orders}""",
)
def sink_audited_load(t):
    """An audit row from the count taken while the rows were written, beside a count of what arrived."""
    orders = t["orders"].select("o_orderkey", "o_totalprice")
    stored = Scratch(t, orders.limit(0))
    audit = W.audited_load(orders, stored.name, "orders")
    return audit.unionByName(
        stored.result().agg(F.count("*").alias("rows_processed")).select(F.lit("orders read back").alias("process_name"), "rows_processed")
    )


@cases.add(
    "etl_chain_resume",
    """SELECT o_custkey, count(*) AS orders, max(o_orderkey) AS newest FROM {orders}
WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
)
def etl_chain_resume(t):
    """A stored chain whose second step fails once: the second run goes on from the stored stage."""
    runs = {"stage": 0, "fact": 0}

    def stage(state):
        runs["stage"] += 1
        return {"stage": state["orders"].where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")}

    def fact(state):
        runs["fact"] += 1
        if runs["fact"] == 1:
            raise OSError("the target is away")
        counts = F.count("*").alias("orders"), F.max("o_orderkey").alias("newest")
        return {"fact": state["stage"].groupBy("o_custkey").agg(*counts)}

    steps = [("stage", stage), ("fact", fact)]
    store = f"{ensure_checkpoint_dir(t.spark)}/chain-{uuid.uuid4().hex}"
    try:
        run_chain(steps, {"orders": t["orders"]}, store, t.spark)
    except RuntimeError:
        pass
    done = run_chain(steps, {"orders": t["orders"]}, store, t.spark)
    if runs != {"stage": 1, "fact": 2}:
        raise AssertionError(f"steps ran {runs}")
    return done["fact"]
