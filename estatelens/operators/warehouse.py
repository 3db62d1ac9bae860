"""Warehouse load patterns as functions of DataFrames and an as-of moment.

Stored procedures become functions with typed, defaulted parameters. None reads the clock unless no
as-of moment is given.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import scalars as S
from estatelens.operators.merge import merge, replace_where, update_from
from estatelens.sinks.tables import load
from estatelens.operators.numbering import newest_numbered
from estatelens.operators.skew import spread_join

Moment = datetime | str | None


# -- extracts


def incremental_extract(
    customers: DataFrame, as_of: Moment = None, days: int = 7, top: int = 500
) -> DataFrame:
    """Active customers updated in the last ``days``, the newest ``top``, numbered."""
    now = S.as_of(as_of)
    recent = customers.filter(
        F.col("is_active") & (F.col("updated_date") >= S.dateadd("DAY", -days, now))
    ).select("customer_id", "customer_code", "middle_name", "created_date", "updated_date")
    order = [F.col("updated_date").desc(), F.col("customer_id").desc()]
    return newest_numbered(recent, order, top).select(
        "customer_id",
        "customer_code",
        S.isnull("middle_name", "").alias("middle_name"),
        S.convert_120("created_date", 10).alias("created_date_str"),
        S.datediff_day("created_date", now).alias("days_since_create"),
        "rn",
    )


def finance_extract(
    ledger: DataFrame, accounts: DataFrame, as_of: Moment = None, days: int = 1
) -> DataFrame:
    """Ledger rows of the last ``days`` with their account."""
    since = S.dateadd("DAY", -days, S.as_of(as_of))
    recent = ledger.filter(F.col("posting_date") >= since)
    return recent.join(accounts, "account_id").select(
        "account_code", "account_name", "amount", "posting_date"
    )


def customer_dimension(customers: DataFrame, as_of: Moment = None, months: int = 3) -> DataFrame:
    """Active customers created in the last ``months``: full name, e-mail or N/A, creation as text."""
    since = S.dateadd("MONTH", -months, S.as_of(as_of))
    recent = customers.filter(F.col("is_active") & (F.col("created_date") >= since))
    return recent.select(
        "customer_id",
        S.plus("first_name", F.lit(" "), "last_name").alias("full_name"),
        S.isnull("email", "N/A").alias("email"),
        S.convert_120("created_date").alias("created_date"),
    )


def active_customers(customers: DataFrame, as_of: Moment = None) -> DataFrame:
    """What the customer stage holds after truncate and load: active customers, stamped."""
    return customers.filter(F.col("is_active")).select(
        "customer_id",
        F.col("customer_code").alias("customer_name"),
        "email",
        F.lit("Active").alias("status"),
        S.as_of(as_of).alias("process_date"),
    )


# -- snapshots


def customer_metrics(
    customers: DataFrame, orders: DataFrame, run_date: Moment, lookback_days: int = 30
) -> DataFrame:
    """Order metrics per customer over the days before ``run_date``.

    Customers without an order in that time are not in the result. Orders are combined per customer
    before they meet the customers, so a customer with very many orders costs one row in the join.
    """
    now = S.as_of(run_date)
    recent = orders.filter(F.col("order_date") >= S.dateadd("DAY", -lookback_days, now))
    totals = recent.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order_date"),
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("total_due"), F.lit(0)).alias("total_spend"),
    )
    return customers.select("customer_id").join(totals, "customer_id").select(
        "customer_id",
        S.as_date(now).alias("snapshot_date"),
        "last_order_date",
        "total_orders",
        "total_spend",
        S.datediff_day("last_order_date", now).alias("days_since_last_order"),
    )


def load_customer_metrics(
    stored: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    run_date: Moment,
    lookback_days: int = 30,
) -> DataFrame:
    """The snapshot table after a run: the run date's rows replaced, all other days kept."""
    rows = customer_metrics(customers, orders, run_date, lookback_days)
    return replace_where(stored, rows, F.col("snapshot_date") == S.as_date(S.as_of(run_date)))


def refresh_customer_metrics(metrics: DataFrame, orders: DataFrame) -> DataFrame:
    """Last order and spend of every customer with orders brought up to date; others unchanged."""
    totals = orders.groupBy("customer_id").agg(
        F.max("order_date").alias("max_date"), F.sum("total_due").alias("total")
    )
    return update_from(
        metrics,
        totals,
        ["customer_id"],
        {"last_order_date": "max_date", "total_spend": "total"},
    )


# -- stock


def update_inventory(stock: DataFrame, movements: DataFrame, as_of: Moment = None) -> DataFrame:
    """Stock after a batch of movements, summed per product and warehouse; moved rows are stamped."""
    keys = ["product_id", "warehouse_id"]
    taken = movements.groupBy(*keys).agg(F.sum("quantity").alias("_taken"))
    moved = F.col("_taken").isNotNull()
    return spread_join(stock, taken, keys, "left").select(
        *keys,
        (F.col("quantity_on_hand") - F.coalesce("_taken", F.lit(0))).alias("quantity_on_hand"),
        F.when(moved, S.as_of(as_of)).otherwise(_stamp(stock)).alias("last_modified"),
    )


def _stamp(stock: DataFrame) -> Column:
    present = "last_modified" in stock.columns
    return F.col("last_modified") if present else F.lit(None).cast("timestamp_ntz")


def inventory_log(movements: DataFrame, as_of: Moment = None) -> DataFrame:
    """A log row per movement, the change negative."""
    return movements.select(
        "product_id",
        "warehouse_id",
        (-F.col("quantity")).alias("quantity_change"),
        S.as_of(as_of).alias("log_date"),
    )


# -- facts


def merge_finance(fact: DataFrame, stage: DataFrame) -> DataFrame:
    """The finance fact after a merge on account and posting date: amount updated, rows inserted."""
    return merge(
        fact,
        stage,
        ["account_code", "posting_date"],
        update=["amount"],
        insert=["account_code", "account_name", "amount", "posting_date"],
    )


def enrich_orders(details: DataFrame, segments: DataFrame) -> DataFrame:
    """Order lines with segment (null if unknown), line amount and value band."""
    amount = F.col("quantity") * F.col("unit_price")
    return details.join(segments, "customer_id", "left").select(
        "order_id",
        "customer_id",
        "segment_name",
        amount.alias("line_amount"),
        F.when(amount > 1000, "HighValue").otherwise("Standard").alias("value_band"),
    )


def daily_stage(sales: DataFrame, as_of: Moment = None) -> DataFrame:
    """Sales of the day."""
    return sales.filter(F.col("sale_date") == S.as_date(S.as_of(as_of))).select(
        "sales_id", "product_id", "amount", "sale_date"
    )


def daily_fact(stage: DataFrame) -> DataFrame:
    """Sales per product and day."""
    return stage.groupBy("product_id", "sale_date").agg(F.sum("amount").alias("amount"))


def update_control(
    control: DataFrame, stage: DataFrame, batch_name: str, as_of: Moment = None
) -> DataFrame:
    """The control table with one batch's run time and row count set."""
    mine = F.col("batch_name") == batch_name
    rows = stage.agg(F.count("*")).scalar()
    return control.select(
        "batch_name",
        F.when(mine, S.as_of(as_of)).otherwise(F.col("last_run")).alias("last_run"),
        F.when(mine, rows).otherwise(F.col("rows_loaded")).alias("rows_loaded"),
    )


def audit_row(
    loaded: DataFrame, process_name: str, as_of: Moment = None, stamp: str | None = None
) -> DataFrame:
    """One audit row: how many rows are loaded, or loaded since the day began if ``stamp`` is named."""
    now = S.as_of(as_of)
    rows = loaded if stamp is None else loaded.filter(F.col(stamp) >= S.as_date(now))
    return rows.agg(F.count("*").alias("rows_processed")).select(
        F.lit(process_name).alias("process_name"), "rows_processed", now.alias("process_date")
    )


def audited_load(rows: DataFrame, table: str, process_name: str) -> DataFrame:
    """Append ``rows`` to a stored table; the audit row has their number, counted while they were written."""
    loaded = load(rows, table)
    return rows.sparkSession.range(1).select(
        F.lit(process_name).alias("process_name"), F.lit(loaded).cast("long").alias("rows_processed")
    )
