"""Named queries on the test tables, each with its SQL statement if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueline.spec import col

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as sums run in any order."""
    return df.select(
        *[
            (F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


# -- SQL shared by the statements ------------------------------------------

ORDER_KEYS = "ts, l_linenumber, l_partkey, l_suppkey"
ORDER_W = f"(PARTITION BY case_id ORDER BY {ORDER_KEYS})"
CLICK_W = "(PARTITION BY case_id ORDER BY ts)"

ORDER_LOG = f"""
order_raw AS (
  SELECT l_orderkey AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS ts,
         CAST(l_suppkey AS VARCHAR) AS resource, l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount,
         nullif(l_returnflag, 'N') AS flag, o_orderpriority,
         nullif(o_orderstatus, 'P') AS status, o_orderdate AS ordered,
         o_orderdate + INTERVAL 30 DAY AS deadline,
         CAST(year(o_orderdate) AS INTEGER) AS case_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
order_log AS (SELECT *, row_number() OVER {ORDER_W} AS event_nr FROM order_raw)"""

CLICK_LOG = f"""
click_raw AS (
  SELECT user_id AS case_id, event_type AS activity, ts,
         json_extract_string(props, '$.k') AS resource, value,
         CAST(year(ts) AS INTEGER) AS year,
         CASE WHEN year(ts) = 2024 THEN TIMESTAMP '2024-01-23 00:00:00' END AS deadline
  FROM events),
click_log AS (SELECT *, row_number() OVER {CLICK_W} AS event_nr FROM click_raw)"""

TURN_LOG = """
turn_log AS (
  SELECT conv_id AS case_id, role AS activity, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_nr
  FROM conversations)"""

SCORE_LOG = """
score_log AS (
  SELECT l.doc_id AS case_id, quality AS y,
         CAST(least(n_chars, 2000) AS DOUBLE) / 2000 AS p,
         CAST(l.doc_id * 37 % 1000 AS DOUBLE) / 999 AS p2
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

RESULT_ROWS = """
result_rows AS (
  SELECT event_type AS Classifier, CAST(day(ts) % 15 AS INTEGER) AS timediff,
         round(avg(value), 5) AS AUC
  FROM events GROUP BY 1, 2)"""

# Days with the number of workdays before each: business-day results are looked
# up here, which is a different way than the closed forms of the library.
DAYS = """
days AS (
  SELECT d, isodow(d) <= 5 AS work,
         coalesce(count(*) FILTER (WHERE isodow(d) <= 5) OVER (
           ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wd
  FROM (SELECT CAST(range AS DATE) AS d
        FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2030-01-01', INTERVAL 1 DAY))),
workdays AS (SELECT d, wd FROM days WHERE work)"""


def hours(start: str, end: str) -> str:
    return f"date_diff('microsecond', {start}, {end}) / 3.6e9"


def seconds(start: str, end: str) -> str:
    return f"date_diff('microsecond', {start}, {end}) / 1e6"


def in_days(start: str, end: str) -> str:
    return f"date_diff('microsecond', {start}, {end}) / 8.64e10"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def labelled(log: str, begin: str, abort: str, name: str = "lab") -> str:
    """CTEs with y and pos of each case and the log with both."""
    return f"""
{name}_at AS (
  SELECT case_id, max(event_nr) FILTER (WHERE activity = '{begin}') AS b,
         max(event_nr) FILTER (WHERE activity = '{abort}') AS a, count(*) AS n
  FROM {log} GROUP BY 1),
{name}_y AS (
  SELECT case_id, CASE WHEN b IS NULL OR a > b THEN 1 ELSE 0 END AS y,
         CASE WHEN b IS NULL OR a > b THEN n ELSE b END AS pos
  FROM {name}_at),
{name} AS (SELECT g.*, y, pos FROM {log} g JOIN {name}_y USING (case_id))"""


def cut(log: str, k: int | str, name: str = "cut") -> str:
    """CTE with the events at least k business days before the deadline."""
    return f"""
{name} AS (
  SELECT g.* FROM {log} g
  JOIN days a ON a.d = CAST(g.deadline AS DATE)
  JOIN workdays w ON w.wd = a.wd - {k}
  WHERE g.ts <= g.deadline + to_days(CAST(date_diff('day', a.d, w.d) AS INTEGER)))"""
