"""Cut each case at a state or ahead of its deadline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.functions import calendar
from dueline.operators.features import activity_is, event_number
from dueline.spec import EventLogSpec, col


def cut_at_state(log: CaseLog, state: str) -> CaseLog:
    """Events up to the first ``state``; cases without it vanish.

    Adds ``state``, the number of that event.
    """
    if not log.has("event_nr"):
        log = event_number(log)
    first = F.min(F.when(activity_is(log.spec, state), col("event_nr")))
    return log.per_case(state=first).filter(col("event_nr") <= col("state"))


def in_time(spec: EventLogSpec, business_days: Column | int) -> Column:
    """Is the event at least so many business days ahead of the deadline?"""
    latest = calendar.minus_business_days(col(spec.deadline), business_days)
    return col(spec.timestamp) <= latest


def cut_before_deadline(log: CaseLog, business_days: int) -> CaseLog:
    """Events no later than that many business days before the deadline.

    Row by row, without a shuffle. A case with no event left vanishes.
    """
    return log.filter(in_time(log.spec, business_days))


def horizons_reached(spec: EventLogSpec, horizons: int) -> Column:
    """Number of horizons 0, 1, .. that still include the event.

    The cut moves back with each horizon, so an event belongs to a leading run
    of them, whose length is the workdays from event to deadline.
    """
    left = calendar.workday_steps(col(spec.timestamp), col(spec.deadline))
    return F.least(F.greatest(left + 1, F.lit(0)), F.lit(horizons))


def horizon_sweep(
    df: DataFrame, spec: EventLogSpec, horizons: int, values: tuple[str, ...] = ()
) -> DataFrame:
    """Events, cases and value sums left at each horizon, in one pass.

    An event belongs to the horizons below its reach and a case to those below
    its largest, so counts by reach are enough: one small number per case is
    shuffled, and what a horizon keeps are sums over at most ``horizons`` rows.
    """
    reached = df.withColumn("_reach", horizons_reached(spec, horizons)).filter(col("_reach") > 0)
    sums = [f"_s{i}" for i in range(len(values))]
    events = reached.groupBy("_reach").agg(
        F.count("*").alias("_n"),
        *[F.sum(F.coalesce(col(v), F.lit(0.0))).alias(s) for v, s in zip(values, sums, strict=True)],
    )
    cases = (
        reached.groupBy(col(spec.case))
        .agg(F.max("_reach").alias("_reach"))
        .groupBy("_reach")
        .agg(F.count("*").alias("_c"))
    )
    steps = df.sparkSession.range(1, horizons + 1).select(F.col("id").cast("int").alias("_reach"))
    counted = steps.join(events, "_reach", "left").join(cases, "_reach", "left")
    # One row per horizon.
    farther = Window.orderBy("_reach").rowsBetween(0, Window.unboundedFollowing)

    def total(name: str) -> Column:
        return F.sum(name).over(farther)

    return counted.select(
        (F.col("_reach") - 1).alias("horizon"),
        F.coalesce(total("_c"), F.lit(0)).alias("n_cases"),
        F.coalesce(total("_n"), F.lit(0)).alias("n_events"),
        *[total(s).alias(f"sum_{v}") for v, s in zip(values, sums, strict=True)],
    )
