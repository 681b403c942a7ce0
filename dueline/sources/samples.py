"""Event logs made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.operators.labeling import deadline_by_year
from dueline.session import prepare
from dueline.spec import EventLogSpec

ORDER_SPEC = EventLogSpec(
    case="case_id",
    activity="activity",
    timestamp="ts",
    resource="resource",
    deadline="deadline",
    order_by=("ts", "l_linenumber", "l_partkey", "l_suppkey"),
    numeric=("l_quantity", "l_extendedprice", "l_discount"),
    dynamic=("activity", "flag"),
    static=("o_orderpriority", "status"),
)
ORDER_BEGIN, ORDER_ABORT = "NO", "RF"

CLICK_SPEC = EventLogSpec(
    case="case_id",
    activity="activity",
    timestamp="ts",
    resource="resource",
    deadline="deadline",
    numeric=("value",),
    dynamic=("activity",),
)
CLICK_BEGIN, CLICK_ABORT = "purchase", "error"
CLICK_STATES = ("view", "click", "signup", "purchase")
CLICK_DEADLINES = {2024: "2024-01-23"}

TURN_SPEC = EventLogSpec(
    case="case_id",
    activity="activity",
    timestamp=None,
    resource=None,
    deadline=None,
    order_by=("turn",),
    dynamic=("activity",),
)
SCORE_SPEC = EventLogSpec(
    case="case_id", activity="case_id", timestamp=None, deadline=None, order_by=("case_id",)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """One event per shipped line of an order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").cast("string").alias("resource"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
    )


def order_cases(spark: SparkSession, folder: str) -> DataFrame:
    """One row of attributes per order."""
    placed = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        "o_orderpriority",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        placed.alias("ordered"),
        (placed + F.make_dt_interval(F.lit(30))).alias("deadline"),
        F.year(placed).alias("case_year"),
    )


def order_log(spark: SparkSession, folder: str, spec: EventLogSpec = ORDER_SPEC) -> CaseLog:
    events = CaseLog.of(order_events(spark, folder), spec)
    return events.join_cases(order_cases(spark, folder), "inner")


def click_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("activity"),
        "ts",
        F.get_json_object("props", "$.k").alias("resource"),
        "value",
    )


def click_log(spark: SparkSession, folder: str, spec: EventLogSpec = CLICK_SPEC) -> CaseLog:
    return CaseLog.of(click_events(spark, folder), spec)


def click_log_with_deadline(spark: SparkSession, folder: str) -> CaseLog:
    log = click_log(spark, folder).with_columns({"year": F.year("ts")})
    return deadline_by_year(log, CLICK_DEADLINES)


def turn_log(spark: SparkSession, folder: str, spec: EventLogSpec = TURN_SPEC) -> CaseLog:
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("role").alias("activity"), "turn"
    )
    return CaseLog.of(turns, spec)


def score_log(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with two scores in [0, 1]."""
    texts = table(spark, folder, "documents").select("doc_id", "n_chars")
    both = table(spark, folder, "labels").select("doc_id", "quality").join(texts, "doc_id")
    return both.select(
        F.col("doc_id").alias("case_id"),
        F.col("quality").alias("y"),
        (F.least("n_chars", F.lit(2000)) / F.lit(2000.0)).alias("p"),
        ((F.col("doc_id") * 37 % 1000) / F.lit(999.0)).alias("p2"),
    )


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a leaderboard: a mean value per event type and day."""
    return (
        table(spark, folder, "events")
        .groupBy(
            F.col("event_type").alias("Classifier"),
            (F.dayofmonth("ts") % 15).alias("timediff"),
        )
        .agg(F.round(F.avg("value"), 5).alias("AUC"))
    )
