"""Differences of zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    return _micros(start, end) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return _micros(start, end) / F.lit(3.6e9)


def days_between(start: Column, end: Column) -> Column:
    return _micros(start, end) / F.lit(8.64e10)


def whole_days_between(start: Column, end: Column) -> Column:
    """Full 24 hour spans, rounded down."""
    return F.floor(days_between(start, end)).cast("int")


def to_zone_free(moment: Column) -> Column:
    """Wall clock time without zone, from text or any timestamp type."""
    return moment.cast("timestamp_ntz")
