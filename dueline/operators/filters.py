"""Filters that keep or drop whole cases, prefixes and membership."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.operators.features import activity_count, with_span
from dueline.spec import EventLogSpec, col


def _moment(value: str | datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def composite_case_key(df: DataFrame, spec: EventLogSpec, suffix: str) -> DataFrame:
    """Make the case id unique per ``suffix`` (such as the year)."""
    return df.withColumn(
        spec.case, F.concat(col(spec.case).cast("string"), col(suffix).cast("string"))
    )


def cases_intersecting(log: CaseLog, start: str, end: str) -> CaseLog:
    """Cases whose span from first to last event meets [start, end]."""
    ts = col(log.spec.timestamp)
    log = log.per_case(_from=F.min(ts), _to=F.max(ts))
    meets = (col("_from") <= _moment(end)) & (col("_to") >= _moment(start))
    return log.filter(meets).drop("_from", "_to")


def cases_starting_in(log: CaseLog, start: str, end: str | None = None) -> CaseLog:
    """Cases whose first event lies in [start, end]; open end allowed."""
    log = log.per_case(_start=log.first(log.spec.timestamp))
    inside = col("_start") >= _moment(start)
    if end is not None:
        inside = inside & (col("_start") <= _moment(end))
    return log.filter(inside).drop("_start")


def cases_ending_in(log: CaseLog, start: str, end: str) -> CaseLog:
    """Cases whose last event lies in [start, end]."""
    inside = col("_end").between(_moment(start), _moment(end))
    return with_span(log).filter(inside).drop("_start", "_end")


def min_activity(log: CaseLog, activity: str, at_least: int) -> CaseLog:
    """Cases that have ``activity`` at least so many times."""
    return activity_count(log, activity, "_hits").filter(col("_hits") >= at_least).drop("_hits")


def prefix_to_position(log: CaseLog, label: int, y: str = "y", pos: str = "pos") -> CaseLog:
    """Events up to the labelled position in cases with this label."""
    return log.filter((col(y) == label) & (col("event_nr") <= col(pos)))


def case_ids_where(df: DataFrame, spec: EventLogSpec, condition: Column) -> DataFrame:
    """Distinct ids of cases with an event that meets ``condition``."""
    return df.filter(condition).select(col(spec.case)).distinct()


def split_by_year(
    df: DataFrame, spec: EventLogSpec, year: str, train: list[int], test: list[int]
) -> tuple[DataFrame, DataFrame]:
    """Case ids by a year attribute: (train, test)."""
    return (
        case_ids_where(df, spec, col(year).isin(*train)),
        case_ids_where(df, spec, col(year).isin(*test)),
    )
