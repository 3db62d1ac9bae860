"""Data-flow components over the given tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from estatelens.cases.base import Cases
from estatelens.cases.sink_cases import Scratch
from estatelens.operators import dataflow as D
from estatelens.session import durable
from estatelens.sinks.tables import identifier, load

cases = Cases()

BANDS = {"large": "o_totalprice > 200000", "urgent": "o_orderpriority = '1-URGENT'"}
BAND = "CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'rest' END"
PLAIN = "o_orderkey, o_custkey, o_totalprice, o_orderpriority"
KEPT = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]


def _orders(t):
    return t["orders"].select(*KEPT)


@cases.add(
    "flow_source_query",
    "SELECT c_custkey AS customer_id, c_name || '/' || c_mktsegment AS label FROM {customer} WHERE c_acctbal >= 0",
)
def flow_source_query(t):
    return D.source_query(
        t.spark,
        "SELECT c_custkey AS customer_id, concat(c_name, :mark, c_mktsegment) AS label FROM {customer} WHERE c_acctbal >= 0",
        {"mark": "/"},
        customer=t["customer"],
    )


@cases.add(
    "flow_destination",
    """SELECT '`dw`.`' || lower(o_orderpriority) || '`' AS destination, count(*) AS rows FROM {orders} GROUP BY o_orderpriority""",
)
def flow_destination(t):
    """Rows per destination a bracketed name stands for, after all were appended to a table named like that."""
    stored = Scratch(t, t["orders"].select("o_orderpriority").limit(0))
    load(t["orders"].select("o_orderpriority"), f"[{stored.name}]")
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    names = F.create_map(
        *[F.lit(x) for p in priorities for x in (p, identifier(f"[dw].[{p.lower()}]"))]
    )
    destination = F.coalesce(
        names[F.col("o_orderpriority")],
        F.concat(F.lit("`dw`.`"), F.lower("o_orderpriority"), F.lit("`")),
    )
    return stored.result().groupBy(destination.alias("destination")).agg(F.count("*").alias("rows"))


@cases.add(
    "flow_append",
    """SELECT account_code, account_name, CAST(posting_date AS VARCHAR) AS posting_date, amount FROM {etl_fact_finance}
UNION ALL SELECT account_code, NULL, CAST(posting_date AS VARCHAR), amount FROM {etl_stage_finance}""",
)
def flow_append(t):
    """A destination after a load whose rows lack one column."""
    return D.destination(t["etl_fact_finance"], t["etl_stage_finance"].drop("account_name"))


REFERENCE = "(SELECT ps.s_nationkey, min(ps.s_name) AS s_name FROM {supplier} ps WHERE ps.s_acctbal > 5000 GROUP BY ps.s_nationkey)"


def _lookup(t):
    suppliers = t["supplier"].filter(F.col("s_acctbal") > 5000)
    return D.lookup(
        t["customer"].select("c_custkey", F.col("c_nationkey").alias("s_nationkey")),
        suppliers,
        ["s_nationkey"],
        ["s_name"],
    )


@cases.add(
    "flow_lookup_match",
    f"SELECT c_custkey, c_nationkey AS s_nationkey, s_name FROM {{customer}} JOIN {REFERENCE} r ON r.s_nationkey = c_nationkey",
)
def flow_lookup_match(t):
    return _lookup(t)["match"]


@cases.add(
    "flow_lookup_nomatch",
    f"SELECT c_custkey, c_nationkey AS s_nationkey FROM {{customer}} WHERE c_nationkey NOT IN (SELECT s_nationkey FROM {REFERENCE})",
)
def flow_lookup_nomatch(t):
    return _lookup(t)["nomatch"]


@cases.add(
    "flow_merge_join",
    """SELECT coalesce(o_custkey, c_custkey) AS key, o_orderkey, c_name FROM {orders} FULL JOIN (SELECT * FROM {customer} WHERE c_acctbal > 0) c ON c_custkey = o_custkey""",
)
def flow_merge_join(t):
    left = t["orders"].select(F.col("o_custkey").alias("key"), "o_orderkey")
    right = t["customer"].filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("key"), "c_name")
    return D.merge_join(left, right, ["key"], "full")


@cases.add(
    "flow_aggregate",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS largest
FROM {orders} GROUP BY o_orderstatus, o_orderpriority""",
)
def flow_aggregate(t):
    return D.aggregate(
        t["orders"],
        ["o_orderstatus", "o_orderpriority"],
        orders="count(*)",
        total="sum(CAST(o_totalprice AS DECIMAL(18,2)))",
        largest="max(o_totalprice)",
    )


@cases.add(
    "flow_row_count",
    "SELECT event_type, count(*) AS rows, CAST((SELECT count(*) FROM {events}) AS BIGINT) AS all_rows FROM {events} GROUP BY event_type",
)
def flow_row_count(t):
    """Rows per output and in all: the total from an observation on the way, read once the rows were written."""
    counted, seen = D.row_count(t["events"].select("event_type"))
    by_type = durable(D.aggregate(counted, ["event_type"], rows="count(*)"))
    return by_type.withColumn("all_rows", F.lit(seen.get["rows"]).cast("long"))


@cases.add(
    "flow_sort",
    "SELECT l_shipdate::DATE::VARCHAR AS ship_date, min(l_orderkey) AS l_orderkey FROM {lineitem} GROUP BY 1",
)
def flow_sort(t):
    """Sorted by day, newest first, duplicates of a day removed."""
    lines = t["lineitem"].select(F.to_date("l_shipdate").alias("ship_date"), "l_orderkey")
    return D.sort(lines, "-ship_date", remove_duplicates=True)


@cases.add(
    "flow_union_all",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM {customer}
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM {supplier}""",
)
def flow_union_all(t):
    customers = t["customer"].selectExpr(
        "c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = t["supplier"].selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return D.union_all(customers, suppliers)


@cases.add(
    "flow_multicast",
    """SELECT 'status' AS output, o_orderstatus AS value, count(*) AS rows FROM {orders} GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM {orders} GROUP BY 2""",
)
def flow_multicast(t):
    first, second = D.multicast(t["orders"], 2)
    return D.union_all(
        first.groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("rows")).withColumn("output", F.lit("status")),
        second.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("rows")).withColumn("output", F.lit("priority")),
    )


@cases.add(
    "flow_data_convert",
    """SELECT 'output' AS branch, raw, TRY_CAST(raw AS DOUBLE) AS number FROM (SELECT "Number of Nodes" AS raw FROM {raw_report}) WHERE raw IS NULL OR TRY_CAST(raw AS DOUBLE) IS NOT NULL
UNION ALL SELECT 'error', raw, NULL FROM (SELECT "Number of Nodes" AS raw FROM {raw_report}) WHERE raw IS NOT NULL AND TRY_CAST(raw AS DOUBLE) IS NULL""",
)
def flow_data_convert(t):
    raw = t["raw_report"].select(
        F.col("`Number of Nodes`").alias("raw"), F.col("`Number of Nodes`").alias("number")
    )
    branches = D.data_convert(raw, {"number": "double"})
    return branches["output"].select(F.lit("output").alias("branch"), "raw", "number").unionByName(
        branches["error"].select(
            F.lit("error").alias("branch"), "raw", F.lit(None).cast("double").alias("number")
        )
    )


@cases.add(
    "flow_derived",
    f"SELECT {PLAIN}, round(o_totalprice * 0.5, 0) AS half, upper(o_orderpriority) || '!' AS shout FROM {{orders}}",
)
def flow_derived(t):
    return D.derive(
        _orders(t), half="round(o_totalprice * 0.5D, 0)", shout="concat(upper(o_orderpriority), '!')"
    )


@cases.add("flow_cond_split", f"SELECT {PLAIN}, {BAND} AS output FROM {{orders}}")
def flow_cond_split(t):
    """All outputs of a conditional split put together again, tagged."""
    outputs = D.conditional_split(_orders(t), BANDS, default="rest")
    return D.union_all(*[df.withColumn("output", F.lit(n)) for n, df in outputs.items()])


@cases.add(
    "flow_command_as_merge",
    """WITH last AS (SELECT l_partkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_quantity)) AS q FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT p_partkey, p_name, coalesce(q, CAST(p_size AS DOUBLE)) AS p_size FROM {part} LEFT JOIN last ON l_partkey = p_partkey""",
)
def flow_command_as_merge(t):
    """A per-row update command over returned lines: the last line of a part decides."""
    parts = t["part"].select("p_partkey", "p_name", F.col("p_size").cast("double").alias("p_size"))
    lines = t["lineitem"].filter(F.col("l_returnflag") == "R").withColumnRenamed("l_partkey", "p_partkey")
    return D.command_as_update(
        parts, lines, ["p_partkey"], {"p_size": "l_quantity"}, ["l_shipdate", "l_orderkey", "l_quantity"]
    )


@cases.add(
    "flow_row_sampling",
    "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100",
)
def flow_row_sampling(t):
    return D.row_sampling(t["orders"].select("o_orderkey", "o_custkey"), 100, "o_orderkey")


@cases.add(
    "flow_foreach",
    """SELECT n_nationkey, n_name, customers, total FROM {nation} LEFT JOIN (SELECT c_nationkey, count(*) AS customers,
  CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {customer} GROUP BY c_nationkey) ON c_nationkey = n_nationkey""",
)
def flow_foreach(t):
    """For each nation: its customers and their balance."""
    customers = t["customer"].withColumnRenamed("c_nationkey", "n_nationkey")
    return D.for_each(
        t["nation"].select("n_nationkey", "n_name"),
        customers,
        ["n_nationkey"],
        customers="count(*)",
        total="sum(CAST(c_acctbal AS DECIMAL(18,2)))",
    )


def _mask_mail(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Example script: the part of an address before the @ hidden."""
    hidden = pc.replace_substring_regex(batch.column("email"), r"^[^@]+", "***")
    return pa.RecordBatch.from_arrays(
        [batch.column("customer_id"), hidden], names=["customer_id", "email"]
    )


@cases.add(
    "flow_script_udf",
    "SELECT customer_id, regexp_replace(email, '^[^@]+', '***') AS email FROM {etl_customer}",
)
def flow_script_udf(t):
    rows = t["etl_customer"].select("customer_id", "email")
    return D.script_component(rows, _mask_mail, "customer_id bigint, email string")


@cases.add(
    "flow_chain",
    f"""SELECT n_name, {BAND} AS output, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * 2) AS DOUBLE) AS doubled
FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} ON n_nationkey = c_nationkey GROUP BY ALL""",
)
def flow_chain(t):
    """Source, lookups, derived column, split and aggregate wired together."""
    source = D.source_query(t.spark, f"SELECT {PLAIN} FROM {{orders}}", orders=t["orders"])
    customers = t["customer"].selectExpr("c_custkey AS o_custkey", "c_nationkey")
    nations = t["nation"].selectExpr("n_nationkey AS c_nationkey", "n_name")
    found = D.lookup(source, customers, ["o_custkey"], ["c_nationkey"])["match"]
    named = D.lookup(found, nations, ["c_nationkey"], ["n_name"])["match"]
    derived = D.derive(
        named,
        doubled="CAST(o_totalprice AS DECIMAL(18,2)) * 2",
        output=D.output_of(BANDS, default="rest"),
    )
    return D.aggregate(derived, ["n_name", "output"], rows="count(*)", doubled="sum(doubled)")
