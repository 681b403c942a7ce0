"""Labels and deadlines of cases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.operators.features import activity_is, event_number
from dueline.spec import col

# Activities that open and cancel a payment, and the last day
# for it in each year.
BEGIN_PAYMENT = "begin payment"
ABORT_PAYMENT = "abort payment"
PAYMENT_DEADLINES = {2015: "2015-12-23", 2016: "2016-12-23", 2017: "2017-12-22"}


def late_payment_label(
    log: CaseLog, begin: str = BEGIN_PAYMENT, abort: str = ABORT_PAYMENT
) -> CaseLog:
    """``y`` = 1 for a case whose payment never began or was aborted after.

    ``pos`` is the last begin of a compliant case, else the last event.
    """
    given = log.has("event_nr")
    if not given:
        log = event_number(log)
    at = lambda a: F.max(F.when(activity_is(log.spec, a), col("event_nr")))
    log = log.per_case(_begin=at(begin), _abort=at(abort), _len=F.count(F.lit(1)))
    paid = col("_begin").isNotNull() & (F.coalesce(col("_abort"), F.lit(0)) <= col("_begin"))
    log = log.with_columns(
        {
            "y": F.when(paid, 0).otherwise(1),
            "pos": F.when(paid, col("_begin")).otherwise(col("_len")),
        }
    )
    return log.drop("_begin", "_abort", "_len", *([] if given else ["event_nr"]))


def year_deadlines(spark: SparkSession, days: dict[int, str], name: str = "deadline") -> DataFrame:
    """Lookup table of year and deadline at midnight."""
    rows = [(y, date.fromisoformat(d)) for y, d in days.items()]
    table = spark.createDataFrame(rows, f"year int, `{name}` date")
    return table.withColumn(name, col(name).cast("timestamp_ntz"))


def deadline_by_year(
    log: CaseLog, days: dict[int, str] = PAYMENT_DEADLINES, name: str = "deadline"
) -> CaseLog:
    """Deadline of the event's year; years without an entry get null.

    The lookup has one row per year, so it is broadcast and no event moves.
    """

    def look_up(df: DataFrame) -> DataFrame:
        table = year_deadlines(df.sparkSession, days, name)
        return df.join(F.broadcast(table), "year", "left")

    return log.map(look_up)
