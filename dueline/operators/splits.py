"""Train and test sets that respect time, and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.operators.ranges import RANGE, cut_into_ranges, range_sizes, row_at, with_position
from dueline.spec import EventLogSpec, col, last_value


def _reached(time: str, spec: EventLogSpec, row) -> Column:
    """Is this (time, case) at or after the given row's?"""
    at, case = F.lit(row[time]).cast("timestamp_ntz"), F.lit(row[spec.case])
    return (col(time) > at) | ((col(time) == at) & (col(spec.case) >= case))


def temporal_split(
    df: DataFrame, spec: EventLogSpec, test_size: float, positions: bool = False
) -> DataFrame:
    """Cases by the time of their last event; the latest share is for testing.

    Gives case, ``case_end`` and ``part`` (train or test), and the 0-based
    ``position`` on demand. Equal ends are ordered by case id.
    """
    ends = df.groupBy(col(spec.case)).agg(last_value(spec, spec.timestamp).alias("case_end"))
    keys = [col("case_end"), col(spec.case)]
    cut = cut_into_ranges(ends, keys)
    sizes = range_sizes(cut)
    n = sum(sizes.values())
    first_test = row_at(cut, sizes, keys, n - math.ceil(test_size * n))
    is_test = F.lit(False) if first_test is None else _reached("case_end", spec, first_test)
    out = with_position(cut, keys) if positions else cut.drop(RANGE)
    return out.withColumn("part", F.when(is_test, "test").otherwise("train"))


def cutoff_split(log: CaseLog, share: float = 0.8) -> tuple[CaseLog, CaseLog]:
    """Train and test events around the start of one case.

    The cutoff is the start of the case at position ``int(n * share)`` by
    start. Training keeps the events before it of cases that started before
    it; testing has the cases that started at or after it. Both gain
    ``StartTime``.
    """
    spec = log.spec
    ts = col(spec.timestamp)
    starts = log.df.groupBy(col(spec.case)).agg(F.min(ts).alias("StartTime"))
    keys = [col("StartTime"), col(spec.case)]
    cut = cut_into_ranges(starts, keys)
    sizes = range_sizes(cut)
    row = row_at(cut, sizes, keys, int(sum(sizes.values()) * share))
    if row is None:
        raise ValueError("no case at the cutoff position")
    cutoff = F.lit(row["StartTime"]).cast("timestamp_ntz")
    log = log.per_case(StartTime=F.min(ts))
    train = log.filter((col("StartTime") < cutoff) & (ts < cutoff))
    return train, log.filter(col("StartTime") >= cutoff)


def split_violations(train: DataFrame, test: DataFrame, spec: EventLogSpec) -> DataFrame:
    """One row: does the split leak?

    ``order_broken``: a training event is not before all test events;
    ``overlap``: not before the start of all test cases; ``shared_cases``:
    number of cases on both sides.
    """
    ts, none = col(spec.timestamp), F.lit(None).cast("timestamp_ntz")

    def side(df: DataFrame, train_ts: Column, test_ts: Column, test_start: Column) -> DataFrame:
        return df.select(
            col(spec.case).alias("case"),
            train_ts.alias("train_ts"),
            test_ts.alias("test_ts"),
            test_start.alias("test_start"),
        )

    per_case = (
        side(train, ts, none, none)
        .unionByName(side(test, none, ts, F.col("StartTime")))
        .groupBy("case")
        .agg(
            F.max("train_ts").alias("train_ts"),
            F.min("test_ts").alias("test_ts"),
            F.min("test_start").alias("test_start"),
        )
    )
    both = col("train_ts").isNotNull() & col("test_ts").isNotNull()
    ends = per_case.agg(
        F.max("train_ts").alias("t"),
        F.min("test_ts").alias("e"),
        F.min("test_start").alias("s"),
        F.count(F.when(both, 1)).alias("shared_cases"),
    )
    return ends.select(
        F.coalesce(F.col("t") >= F.col("e"), F.lit(False)).alias("order_broken"),
        F.coalesce(F.col("t") >= F.col("s"), F.lit(False)).alias("overlap"),
        "shared_cases",
    )


def assert_temporal_split(train: DataFrame, test: DataFrame, spec: EventLogSpec) -> None:
    found = split_violations(train, test, spec).first()
    if found["order_broken"] or found["overlap"] or found["shared_cases"]:
        raise AssertionError(f"split is not temporal: {found.asDict()}")


def in_holdout(spec: EventLogSpec, share: float, seed: int = 42) -> Column:
    """Random part of the cases, the same under any partitioning."""
    spot = F.pmod(F.xxhash64(col(spec.case), F.lit(seed)), F.lit(1_000_000))
    return spot < int(share * 1_000_000)


def random_split(
    cases: DataFrame, spec: EventLogSpec, train_share: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Random train and validation rows by case id."""
    held = in_holdout(spec, train_share, seed)
    return cases.filter(held), cases.filter(~held)


def stratified_folds(
    cases: DataFrame, spec: EventLogSpec, label: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: random, and even over the labels.

    Cases are put in order of (label, hash, id) and dealt out in turn, so each
    label differs by at most one case between folds.
    """
    spot = F.xxhash64(col(spec.case), F.lit(seed))
    keys = [col(label), F.col("_spot"), col(spec.case)]
    cut = cut_into_ranges(cases.withColumn("_spot", spot), keys)
    placed = with_position(cut, keys, "_position")
    fold = (F.col("_position") % folds).cast("int")
    return placed.withColumn("fold", fold).drop("_position", "_spot")
