"""Scalar functions over whole table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.cases.base import Cases
from estatelens.functions import scalars as S

cases = Cases()


@cases.add(
    "sc_normalize_name",
    r"""SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^\pL\pM\p{{Nd}}\p{{Pc}}]+', '_', 'g'), '_') AS name FROM {pages}""",
)
def sc_normalize_name(t):
    return t["pages"].select("page_id", S.normalize_name("url").alias("name"))


@cases.add(
    "sc_to_number",
    """SELECT "Number of Nodes" AS raw, coalesce(CAST(trunc(TRY_CAST("Number of Nodes" AS DOUBLE)) AS BIGINT), 0) AS n FROM {raw_report}""",
)
def sc_to_number(t):
    return t["raw_report"].select(
        F.col("`Number of Nodes`").alias("raw"), S.to_number("Number of Nodes").alias("n")
    )


@cases.add(
    "sc_concat_null",
    "SELECT customer_id, first_name || ' ' || last_name AS full_name FROM {etl_customer}",
)
def sc_concat_null(t):
    return t["etl_customer"].select(
        "customer_id", S.plus("first_name", F.lit(" "), "last_name").alias("full_name")
    )


@cases.add(
    "sc_isnull",
    "SELECT customer_id, coalesce(middle_name, '') AS middle_name, coalesce(email, 'N/A') AS email FROM {etl_customer}",
)
def sc_isnull(t):
    return t["etl_customer"].select(
        "customer_id",
        S.isnull("middle_name", "").alias("middle_name"),
        S.isnull("email", "N/A").alias("email"),
    )


@cases.add(
    "sc_convert_120",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS full_text, strftime(ts, '%Y-%m-%d') AS day_text FROM {events}",
)
def sc_convert_120(t):
    return t["events"].select(
        "event_id",
        S.convert_120("ts").alias("full_text"),
        S.convert_120("ts", 10).alias("day_text"),
    )


@cases.add(
    "sc_datediff_day",
    """SELECT event_id, CAST(date_diff('day', ts, TIMESTAMP '2024-02-01 00:30:00') AS INT) AS days,
  CAST(date_diff('month', ts, TIMESTAMP '2024-02-01 00:30:00') AS INT) AS months FROM {events}""",
)
def sc_datediff_day(t):
    end = S.as_of("2024-02-01 00:30:00")
    return t["events"].select(
        "event_id",
        S.datediff_day("ts", end).alias("days"),
        S.datediff_month("ts", end).alias("months"),
    )


@cases.add(
    "sc_dateadd",
    """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before,
  strftime(o_orderdate - INTERVAL 3 MONTH, '%Y-%m-%d') AS quarter_before FROM {orders}""",
)
def sc_dateadd(t):
    return t["orders"].select(
        "o_orderkey",
        S.as_date(S.dateadd("DAY", -7, "o_orderdate")).alias("week_before"),
        S.as_date(S.dateadd("MONTH", -3, "o_orderdate")).alias("quarter_before"),
    )


@cases.add(
    "sc_line_count",
    """SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
  left(regexp_extract(text, '^[^\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]*'), 200) AS head FROM {documents}""",
)
def sc_line_count(t):
    return t["documents"].select(
        "doc_id", S.line_count("text").alias("lines"), S.first_line("text", 200).alias("head")
    )


