"""Warehouse load patterns over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.cases.base import Cases
from estatelens.cases.sink_cases import inserted, loaded
from estatelens.cases.views import AS_OF
from estatelens.functions import scalars as S
from estatelens.operators import merge as M
from estatelens.operators import quality as Q
from estatelens.operators import warehouse as W
from estatelens.operators.dataflow import source_query

cases = Cases()

NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"
NOW_TEXT = f"'{AS_OF} 00:00:00'"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
DAY = "CAST({0} AS VARCHAR)"
MONEY = "CAST({0} AS DOUBLE)"


def rules():
    return {"null_email": F.col("customer_email").isNull(), "negative_amount": F.col("order_amount") < 0}


# -- extracts and stages


@cases.add(
    "etl_incremental_extract",
    f"""SELECT customer_id, customer_code, coalesce(middle_name, '') AS middle_name, strftime(created_date, '%Y-%m-%d') AS created_date_str,
  CAST(date_diff('day', created_date, {NOW}) AS INT) AS days_since_create, CAST(row_number() OVER (ORDER BY updated_date DESC, customer_id DESC) AS INT) AS rn
FROM {{etl_customer}} WHERE is_active AND updated_date >= {NOW} - INTERVAL 7 DAY ORDER BY updated_date DESC, customer_id DESC LIMIT 500""",
)
def etl_incremental_extract(t):
    return W.incremental_extract(t["etl_customer"], AS_OF)


@cases.add(
    "etl_finance_extract",
    f"""SELECT account_code, account_name, {MONEY.format("amount")} AS amount, {TS.format("posting_date")} AS posting_date
FROM {{etl_ledger}} JOIN {{etl_account}} USING (account_id) WHERE posting_date >= {NOW} - INTERVAL 1 DAY""",
)
def etl_finance_extract(t):
    return W.finance_extract(t["etl_ledger"], t["etl_account"], AS_OF)


@cases.add(
    "etl_customer_dim",
    f"""SELECT customer_id, first_name || ' ' || last_name AS full_name, coalesce(email, 'N/A') AS email, {TS.format("created_date")} AS created_date
FROM {{etl_customer}} WHERE is_active AND created_date >= {NOW} - INTERVAL 36 MONTH""",
)
def etl_customer_dim(t):
    return W.customer_dimension(t["etl_customer"], AS_OF, months=36)


@cases.add(
    "etl_insert_select",
    f"""SELECT customer_id, customer_code AS customer_name, email, 'Active' AS status, {NOW_TEXT} AS process_date FROM {{etl_customer}} WHERE is_active""",
)
def etl_insert_select(t):
    """The customer stage after INSERT … SELECT of the active customers."""
    return inserted(t, W.active_customers(t["etl_customer"], AS_OF))


@cases.add(
    "etl_truncate_load",
    f"""SELECT account_code, account_name, {MONEY.format("amount")} AS amount, {DAY.format("posting_date")} AS posting_date FROM {{etl_stage_finance}}""",
)
def etl_truncate_load(t):
    """The stage after truncate and load: nothing of its old rows, all of the new ones."""
    return loaded(t, t["etl_fact_finance"], t["etl_stage_finance"])


@cases.add(
    "etl_enrich_band",
    """SELECT d.order_id, d.customer_id, s.segment_name, d.quantity * d.unit_price AS line_amount,
  CASE WHEN d.quantity * d.unit_price > 1000 THEN 'HighValue' ELSE 'Standard' END AS value_band
FROM {etl_order_detail} d LEFT JOIN {etl_segment} s ON s.customer_id = d.customer_id""",
)
def etl_enrich_band(t):
    return W.enrich_orders(t["etl_order_detail"], t["etl_segment"])


STAGE = f"SELECT * FROM {{etl_sales}} WHERE sale_date = DATE '{AS_OF}'"


@cases.add(
    "etl_daily_stage",
    f"""SELECT sales_id, product_id, {MONEY.format("amount")} AS amount, {DAY.format("sale_date")} AS sale_date FROM ({STAGE})""",
)
def etl_daily_stage(t):
    return W.daily_stage(t["etl_sales"], AS_OF)


@cases.add(
    "etl_daily_fact",
    f"""SELECT product_id, {DAY.format("sale_date")} AS sale_date, {MONEY.format("sum(amount)")} AS amount FROM {{etl_sales}} GROUP BY product_id, sale_date""",
)
def etl_daily_fact(t):
    """Over all staged days."""
    return W.daily_fact(t["etl_sales"])


@cases.add(
    "etl_control_update",
    f"""SELECT batch_name, CASE WHEN batch_name = '2-HIGH' THEN {NOW_TEXT} ELSE {TS.format("last_run")} END AS last_run,
  CASE WHEN batch_name = '2-HIGH' THEN (SELECT count(*) FROM ({STAGE})) ELSE rows_loaded END AS rows_loaded FROM {{etl_control}}""",
)
def etl_control_update(t):
    return W.update_control(t["etl_control"], W.daily_stage(t["etl_sales"], AS_OF), "2-HIGH", AS_OF)


@cases.add(
    "etl_audit",
    f"""SELECT 'DailySales' AS process_name, count(*) AS rows_processed, {NOW_TEXT} AS process_date FROM {{etl_sales}} WHERE sale_date >= DATE '{AS_OF}'
UNION ALL SELECT 'AllSales', count(*), {NOW_TEXT} FROM {{etl_sales}}""",
)
def etl_audit(t):
    return W.audit_row(t["etl_sales"], "DailySales", AS_OF, stamp="sale_date").unionByName(
        W.audit_row(t["etl_sales"], "AllSales", AS_OF)
    )


@cases.add(
    "etl_param_query",
    """SELECT 'LoadOrders' AS process_name, o_orderpriority AS priority, count(*) AS rows_processed FROM {orders} WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY o_orderpriority""",
)
def etl_param_query(t):
    """A statement with bound parameters."""
    return source_query(
        t.spark,
        """SELECT :process AS process_name, o_orderpriority AS priority, count(*) AS rows_processed FROM {orders}
WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY o_orderpriority""",
        {"process": "LoadOrders", "since": "2001-01-01 00:00:00"},
        orders=t["orders"],
    )


@cases.add(
    "etl_pk_check",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def etl_pk_check(t):
    return M.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


# -- snapshots

METRICS = f"""metrics AS (SELECT c.customer_id, DATE '{AS_OF}' AS snapshot_date, max(o.order_date) AS last_order_date, count(*) AS total_orders,
  coalesce(sum(o.total_due), 0) AS total_spend, date_diff('day', max(o.order_date), {NOW}) AS days_since_last_order
  FROM {{etl_customer}} c LEFT JOIN {{etl_order_header}} o ON o.customer_id = c.customer_id WHERE o.order_date >= {NOW} - INTERVAL 30 DAY GROUP BY c.customer_id)"""
SNAPSHOT = f"""customer_id, {DAY.format("snapshot_date")} AS snapshot_date, {TS.format("last_order_date")} AS last_order_date, total_orders,
  {MONEY.format("total_spend")} AS total_spend"""


@cases.add(
    "etl_customer_metrics",
    f"WITH {METRICS} SELECT {SNAPSHOT}, CAST(days_since_last_order AS INT) AS days_since_last_order FROM metrics",
)
def etl_customer_metrics(t):
    return W.customer_metrics(t["etl_customer"], t["etl_order_header"], AS_OF)


@cases.add(
    "etl_snapshot_replace",
    f"""WITH {METRICS} SELECT {SNAPSHOT}, CAST(days_since_last_order AS BIGINT) AS days_since_last_order FROM metrics
UNION ALL SELECT {SNAPSHOT}, days_since_last_order FROM {{etl_metrics_state}} WHERE snapshot_date <> DATE '{AS_OF}'""",
)
def etl_snapshot_replace(t):
    return W.load_customer_metrics(
        t["etl_metrics_state"], t["etl_customer"], t["etl_order_header"], AS_OF
    )


@cases.add(
    "etl_update_from_agg",
    f"""WITH m AS (SELECT * FROM {{etl_metrics_state}}),
o AS (SELECT customer_id, max(order_date) AS md, sum(total_due) AS tt FROM {{etl_order_header}} WHERE total_due > 100000 GROUP BY customer_id)
SELECT m.customer_id, {DAY.format("m.snapshot_date")} AS snapshot_date, {TS.format("coalesce(o.md, m.last_order_date)")} AS last_order_date, m.total_orders,
  coalesce(CAST(o.tt AS DOUBLE), m.total_spend) AS total_spend, m.days_since_last_order
FROM m LEFT JOIN o ON o.customer_id = m.customer_id""",
)
def etl_update_from_agg(t):
    """Metrics refreshed from large orders; customers without one keep their row."""
    large = t["etl_order_header"].filter(F.col("total_due") > 100000)
    return W.refresh_customer_metrics(t["etl_metrics_state"], large)


# -- stock


@cases.add(
    "etl_inventory_update",
    f"""SELECT i.product_id, i.warehouse_id, i.quantity_on_hand - coalesce(m.q, 0) AS quantity_on_hand, CASE WHEN m.q IS NOT NULL THEN {NOW_TEXT} END AS last_modified
FROM {{etl_inventory}} i LEFT JOIN (SELECT product_id, warehouse_id, CAST(sum(quantity) AS BIGINT) AS q FROM {{etl_movements}} GROUP BY ALL) m USING (product_id, warehouse_id)""",
)
def etl_inventory_update(t):
    return W.update_inventory(t["etl_inventory"], t["etl_movements"], AS_OF)


@cases.add(
    "etl_log_insert",
    f"SELECT product_id, warehouse_id, -quantity AS quantity_change, {NOW_TEXT} AS log_date FROM {{etl_movements}}",
)
def etl_log_insert(t):
    """The log table after the movements were inserted."""
    return inserted(t, W.inventory_log(t["etl_movements"], AS_OF))


# -- facts


@cases.add(
    "etl_merge_fact",
    f"""SELECT coalesce(f.account_code, s.account_code) AS account_code, coalesce(f.account_name, s.account_name) AS account_name,
  {DAY.format("coalesce(f.posting_date, s.posting_date)")} AS posting_date, coalesce(s.amount, f.amount) AS amount
FROM {{etl_fact_finance}} f FULL JOIN {{etl_stage_finance}} s ON s.account_code = f.account_code AND s.posting_date = f.posting_date""",
)
def etl_merge_fact(t):
    return W.merge_finance(t["etl_fact_finance"], t["etl_stage_finance"])


# -- slowly changing dimension

CURRENT = "(SELECT * FROM {etl_dim_product} WHERE is_current = 1)"
CHANGED = f"""changed AS (SELECT p.* FROM {{etl_product}} p LEFT JOIN {CURRENT} d ON d.product_id = p.product_id
  WHERE d.product_id IS NULL OR d.list_price <> p.list_price)"""
EXPIRED = f"""expired AS (
  SELECT product_id, product_name, list_price, category, CASE WHEN hit THEN 0 ELSE is_current END AS is_current,
    CASE WHEN hit THEN '{AS_OF}' ELSE CAST(end_date AS VARCHAR) END AS end_date
  FROM (SELECT *, is_current = 1 AND product_id IN (SELECT p.product_id FROM {{etl_product}} p JOIN {CURRENT} d ON d.product_id = p.product_id WHERE d.list_price <> p.list_price) AS hit FROM {{etl_dim_product}}))"""


@cases.add("etl_scd2_changed", f"WITH {CHANGED} SELECT * FROM changed")
def etl_scd2_changed(t):
    return M.scd2_changed(t["etl_dim_product"], t["etl_product"], "product_id", ["list_price"])


@cases.add("etl_scd2_expire", f"WITH {EXPIRED} SELECT * FROM expired")
def etl_scd2_expire(t):
    return M.scd2_expire(
        t["etl_dim_product"], t["etl_product"], "product_id", ["list_price"], S.as_date(S.as_of(AS_OF))
    )


@cases.add(
    "etl_scd2_apply",
    f"WITH {CHANGED}, {EXPIRED} SELECT * FROM expired UNION ALL SELECT *, 1, NULL FROM changed",
)
def etl_scd2_apply(t):
    return M.scd2_apply(
        t["etl_dim_product"], t["etl_product"], "product_id", ["list_price"], S.as_date(S.as_of(AS_OF))
    )


# -- data quality

REASON = "CASE WHEN customer_email IS NULL THEN 'null_email' WHEN order_amount < 0 THEN 'negative_amount' END"


@cases.add(
    "etl_dq_rules",
    """SELECT 'null_email' AS rule, count(*) AS failed_rows FROM {etl_raw_orders} WHERE customer_email IS NULL
UNION ALL SELECT 'negative_amount', count(*) FROM {etl_raw_orders} WHERE order_amount < 0""",
)
def etl_dq_rules(t):
    return Q.rule_counts(t["etl_raw_orders"], rules())


@cases.add(
    "etl_dq_quarantine",
    f"SELECT *, {REASON} AS dq_reason FROM {{etl_raw_orders}} WHERE customer_email IS NULL OR order_amount < 0",
)
def etl_dq_quarantine(t):
    return Q.quarantine(t["etl_raw_orders"], rules())


@cases.add("etl_dq_valid", f"SELECT * FROM {{etl_raw_orders}} WHERE {REASON} IS NULL")
def etl_dq_valid(t):
    return Q.valid(t["etl_raw_orders"], rules())
