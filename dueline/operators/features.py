"""Features of an event from its case, its neighbours and the calendar.

Each function takes a ``CaseLog`` and returns it with new columns. Running sums
of gaps telescope: the time from the first event to this one is one
subtraction, so nothing is summed up along a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.functions import calendar, timing
from dueline.spec import EventLogSpec, col

REMAINING_BUSINESS_TIME = "remaining bus. hours / 24"


def count_cases(df: DataFrame, spec: EventLogSpec) -> DataFrame:
    """One row with the number of distinct cases."""
    return df.agg(F.countDistinct(col(spec.case)).alias("n_cases"))


def count_cases_approx(df: DataFrame, spec: EventLogSpec, error: float = 0.02) -> DataFrame:
    """The same from mergeable sketches: one pass, no shuffle of ids.

    ``error`` is the relative standard deviation of the estimate.
    """
    return df.agg(F.approx_count_distinct(col(spec.case), error).alias("n_cases"))


def activity_is(spec: EventLogSpec, activity: str) -> Column:
    return col(spec.activity) == F.lit(activity)


def activity_count(log: CaseLog, activity: str, name: str | None = None) -> CaseLog:
    """How often the case has ``activity``, on every event; 0 if never."""
    hits = F.count(F.when(activity_is(log.spec, activity), 1))
    return log.per_case(**{name or f"Count {activity}": hits})


def trace_length(log: CaseLog, name: str = "trace_length") -> CaseLog:
    return log.per_case(**{name: F.count(F.lit(1))})


def event_number(log: CaseLog, name: str = "event_nr") -> CaseLog:
    """1-based position of the event in its case."""
    return log.in_order(number=name)


def with_span(log: CaseLog) -> CaseLog:
    """Helper columns ``_start`` and ``_end``: first and last event time."""
    ts = log.spec.timestamp
    return log.per_case(_start=log.first(ts), _end=log.last(ts))


def event_duration(log: CaseLog) -> CaseLog:
    """Hours to the next event of the case; null on the last one."""
    ts = log.spec.timestamp
    log = log.in_order(following={"_next": ts})
    hours = timing.hours_between(col(ts), col("_next"))
    return log.with_columns({"duration": hours}).drop("_next")


def time_since_last_event(log: CaseLog) -> CaseLog:
    """Seconds since the event before; 0 on the first one."""
    ts = log.spec.timestamp
    log = log.in_order(previous={"_prev": ts})
    seconds = F.coalesce(timing.seconds_between(col("_prev"), col(ts)), F.lit(0.0))
    return log.with_columns({"time_since_last_event": seconds}).drop("_prev")


def time_since_first_event(log: CaseLog) -> CaseLog:
    """Seconds since the first event of the case."""
    ts = log.spec.timestamp
    log = log.per_case(_start=log.first(ts))
    seconds = timing.seconds_between(col("_start"), col(ts))
    return log.with_columns({"time_since_first_event": seconds}).drop("_start")


def cumulative_duration(log: CaseLog) -> CaseLog:
    """Hours from the first event to the one after this; null on the last."""
    ts = log.spec.timestamp
    log = log.per_case(_start=log.first(ts)).in_order(following={"_next": ts})
    hours = timing.hours_between(col("_start"), col("_next"))
    return log.with_columns({"cumulative_duration": hours}).drop("_start", "_next")


def total_duration(log: CaseLog) -> CaseLog:
    """Hours between first and last event, on every event of the case."""
    hours = timing.hours_between(col("_start"), col("_end"))
    return with_span(log).with_columns({"total_duration": hours}).drop("_start", "_end")


def remaining_time(log: CaseLog) -> CaseLog:
    """Days to the last event of the case."""
    ts = log.spec.timestamp
    log = log.per_case(_end=log.last(ts))
    return log.with_columns({"remaining_time": timing.days_between(col(ts), col("_end"))}).drop("_end")


def remaining_business_days(
    log: CaseLog, days_off: calendar.Holidays | None = None
) -> CaseLog:
    """Time to the end of the case, less the days that are not workdays.

    ``days_off`` are public holidays, none by default.

    ``holidays`` compares full 24 hour spans with workday dates, so a short
    night across midnight gives -1; that is the measure as defined.
    """
    ts = log.spec.timestamp
    log = log.per_case(end_timestamp=log.last(ts))
    start, end = col(ts), col("end_timestamp")
    days = timing.whole_days_between(start, end)
    workdays = calendar.business_days_between(start, end, days_off or calendar.Holidays([]))
    left = timing.days_between(start, end)
    return log.with_columns(
        {
            "remaining_time": left,
            "days_count": days,
            "bus_days_between": workdays,
            "holidays": days - workdays,
            REMAINING_BUSINESS_TIME: left - (days - workdays),
        }
    )


def time_attributes(log: CaseLog) -> CaseLog:
    """Calendar parts of the event time; Monday is weekday 0."""
    ts = col(log.spec.timestamp)
    return log.with_columns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "weekday": F.weekday(ts),
            "hour": F.hour(ts),
            "dayofyear": F.dayofyear(ts),
        }
    )


def case_start(log: CaseLog, name: str = "StartTime") -> CaseLog:
    """Earliest event time of the case, on every event."""
    return log.per_case(**{name: F.min(col(log.spec.timestamp))})


def spread_last(log: CaseLog, name: str) -> CaseLog:
    """Replace a column by its last non-null value in the case."""
    log = log.per_case(_last=log.last(name))
    return log.with_columns({name: col("_last")}).drop("_last")
