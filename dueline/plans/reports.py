"""Descriptive reports over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueline.caselog import CaseLog
from dueline.functions import calendar
from dueline.operators.features import (
    REMAINING_BUSINESS_TIME,
    event_number,
    remaining_business_days,
)
from dueline.operators.filters import prefix_to_position
from dueline.operators.ranges import group_percentiles
from dueline.session import staged
from dueline.spec import EventLogSpec, col, last_value

# Inclusive ranges of business days in the share report, and
# whiskers in units of the quartile distance.
DAY_RANGES = ((0, 3), (4, 7), (8, 11), (12, 15))
WHISKER = 1.5
# Relative error of a sketch of distinct values, and errors that rule a count out.
SKETCH_ERROR, SIGMAS = 0.02, 6


def last_event_business_days(log: CaseLog) -> DataFrame:
    """Per compliant case: business days from its decisive event to deadline.

    ``log`` has ``event_nr``, ``y``, ``pos`` and ``year``. ``signed`` counts
    from the deadline to the event, so early events are below zero there.
    """
    spec = log.spec
    prefix = prefix_to_position(log, 0)
    signed = calendar.business_days_between(col(spec.deadline), col(spec.timestamp))
    nr = col("event_nr")
    return (
        prefix.df.withColumn("_signed", signed)
        .groupBy(col(spec.case))
        .agg(
            F.max_by("_signed", F.when(F.col("_signed").isNotNull(), nr)).alias("signed"),
            F.max_by("year", F.when(F.col("year").isNotNull(), nr)).alias("year"),
        )
        .withColumn("business_days_until_deadline", -F.col("signed"))
    )


def approvals_in_time(df: DataFrame, spec: EventLogSpec, activity: str, late: str) -> DataFrame:
    """Events of one activity in cases that are not late, with days left."""
    left = calendar.business_days_left(col(spec.timestamp), col(spec.deadline))
    kept = df.filter((col(spec.activity) == activity) & ~col(late))
    return kept.withColumn("business_days_until_deadline", left)


def frequencies(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n"))


def unit_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in bins of width one from 0 to the largest value.

    Equal values are counted first; what follows has one row per value. Empty
    bins count 0, negative values lie outside.
    """
    bins = (
        df.filter(col(value) >= 0)
        .groupBy(F.floor(col(value)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = bins.agg(F.max("bin").alias("top")).select(
        F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin")
    )
    return every.join(bins, "bin", "left").fillna(0, ["n"])


def equal_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins from least to largest value, the last one closed.

    A column with one value gets bins over a width of one around it. Equal
    values are counted first; missing values and such that are no number are out.
    """
    v = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    counted = df.groupBy(v.alias("v")).agg(F.count("*").alias("c")).filter("v IS NOT NULL")
    ends = counted.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    # One row.
    ends = F.broadcast(ends.select((F.col("a") - half).alias("lo"), (F.col("b") + half).alias("hi")))
    spot = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    placed = counted.join(ends).select(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"), "c")
    filled = placed.groupBy("bin").agg(F.sum("c").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").fillna(0, ["n"])


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, quartiles and ends of a numeric column, as one row.

    The column is written once; quartiles come from its values in global order, so it
    may have any number of them. Of no rows all but the count are null.
    """
    v = col(value)
    once = staged(df.select(F.lit(1).alias("_all"), v), "described")
    quartiles = group_percentiles(once, ["_all"], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    facts = once.agg(
        F.lit(1).alias("_all"),
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    # One row each.
    return facts.join(quartiles, "_all", "left").select(
        "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def range_shares(
    df: DataFrame, value: str, ranges: tuple[tuple[int, int], ...] = DAY_RANGES
) -> DataFrame:
    """Percentage of all rows in each inclusive range, as one row."""
    return df.agg(
        *[
            (F.count(F.when(col(value).between(a, b), 1)) / F.count("*") * 100).alias(f"d{a}_{b}")
            for a, b in ranges
        ]
    )


def remaining_by_state(log: CaseLog, states: tuple[str, ...], label: int = 1) -> DataFrame:
    """Remaining business time of a case when it first enters each state.

    ``log`` has ``y`` and ``pos``. A prefix that ends at the first event of a
    state has that event as its last, so one aggregate over the events of all
    states gives what a pass per state would.
    """
    if not log.has("event_nr"):
        log = event_number(log)
    spec = log.spec
    prefix = remaining_business_days(prefix_to_position(log, label))
    entered = prefix.filter(col(spec.activity).isin(*states)).df
    return entered.groupBy(col(spec.case), col(spec.activity).alias("state")).agg(
        F.min_by(col(REMAINING_BUSINESS_TIME), col("event_nr")).alias("remaining")
    )


def state_stats(by_state: DataFrame) -> DataFrame:
    """Median, mean and deviation per state; the rows are written once, for two passes."""
    by_state = staged(by_state, "by_state")
    middle = group_percentiles(by_state, ["state"], "remaining", {"median": 0.5})
    rest = by_state.groupBy("state").agg(
        F.avg("remaining").alias("mean"), F.stddev_samp("remaining").alias("std")
    )
    # One row per state on either side.
    return middle.join(F.broadcast(rest), "state")


def percentile_of_score(df: DataFrame, value: str, scores: dict[str, float]) -> DataFrame:
    """Percentage of values at or below each score, ties taken as half."""
    v = col(value)

    def share(score: float) -> Column:
        below = F.count(F.when(v < F.lit(score), 1))
        upto = F.count(F.when(v <= F.lit(score), 1))
        extra = F.when(below < upto, 1).otherwise(0)
        return F.try_divide((below + upto + extra) * F.lit(50.0), F.count(v))

    return df.agg(*[share(s).alias(n) for n, s in scores.items()])


def state_box(by_state: DataFrame) -> DataFrame:
    """Quartiles, whiskers and number of outliers per state.

    Whiskers reach to the last values within 1.5 quartile distances. There is
    one row of quartiles per state, which is broadcast back to the values. These
    are written once, for two passes.
    """
    by_state = staged(by_state, "by_state")
    quartiles = group_percentiles(
        by_state, ["state"], "remaining", {"q1": 0.25, "med": 0.5, "q3": 0.75}
    )
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    v = F.col("remaining")
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        by_state.join(F.broadcast(quartiles), "state")
        .groupBy("state", "q1", "med", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("low"),
            F.max(F.when(inside, v)).alias("high"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
    )


def state_outliers(by_state: DataFrame, box: DataFrame) -> DataFrame:
    """The values beyond the whiskers."""
    ends = box.select("state", "low", "high")
    v = F.col("remaining")
    rows = by_state.join(F.broadcast(ends), "state")
    return rows.filter((v < F.col("low")) | (v > F.col("high"))).drop("low", "high")


def _metrics(one_row: DataFrame) -> DataFrame:
    """Turn a one-row table into rows (metric, value)."""
    pairs = [
        F.struct(F.lit(c).alias("metric"), col(c).cast("double").alias("value"))
        for c in one_row.columns
    ]
    return one_row.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")


def _per_case(df: DataFrame, spec: EventLogSpec, label: str) -> DataFrame:
    return df.groupBy(col(spec.case)).agg(
        F.count("*").alias("events"), last_value(spec, label).cast("double").alias("late")
    )


def _as_many_as_cases(df: DataFrame, spec: EventLogSpec, columns: list[str]) -> list[str]:
    """Columns that may have exactly as many values as there are cases.

    Sketches of all columns are merged in one pass, without a shuffle of values.
    A column is ruled out if its estimate is ``SIGMAS`` errors off.
    """
    names = [spec.case, *columns]
    found = df.agg(*[F.approx_count_distinct(col(c), SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(names)]).first()
    room = 1 + SIGMAS * SKETCH_ERROR
    low, high = found[0] / room**2, found[0] * room**2
    return [c for c, n in zip(columns, list(found)[1:], strict=True) if low <= n <= high]


def log_statistics(df: DataFrame, spec: EventLogSpec, label: str) -> DataFrame:
    """Size, class ratio and kinds of attributes of a log.

    Exact distinct counts are only taken of cases, activities and the columns that
    a sketch does not rule out. The log is written once, as three passes read it.
    """
    df = staged(df, "log")
    fields = df.schema.fields
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    texts = [
        f.name
        for f in fields
        if isinstance(f.dataType, T.StringType) and f.name not in (spec.case, spec.activity)
    ]
    # The number of distinct lengths k needs k * k / 2 events, so the median
    # keeps a small table of counters whatever the log.
    cases = _per_case(df, spec, label).agg(
        F.count("*").alias("n_cases"),
        F.avg("late").alias("positive_class_ratio"),
        F.median("events").alias("median_trace_length"),
    )
    likely = _as_many_as_cases(df, spec, [f.name for f in fields if f.name != spec.case])
    distinct = df.agg(
        F.countDistinct(col(spec.case)).alias("cases"),
        F.countDistinct(col(spec.activity)).alias("activities"),
        *[F.countDistinct(col(c)).alias(f"d{i}") for i, c in enumerate(likely)],
    )
    same = F.lit(1)
    for i in range(len(likely)):
        same = same + (F.col(f"d{i}") == F.col("cases")).cast("int")
    columns = distinct.select(
        F.lit(len(numeric)).alias("n_numerical_attributes"),
        same.alias("n_case_attributes"),
        F.lit(len(texts)).alias("n_cat_event_attributes"),
        F.col("activities").alias("n_activity_classes"),
    )
    return _metrics(cases).unionByName(_metrics(columns))


def log_summary(df: DataFrame, spec: EventLogSpec, label: str) -> DataFrame:
    """Cases, events, events per case, activity classes, positive ratio."""
    cases = _per_case(df, spec, label).agg(
        F.count("*").alias("cases"),
        F.sum("events").alias("events"),
        F.avg("events").alias("mean_events"),
        F.median("events").alias("median_events"),
        F.avg("late").alias("positive_ratio"),
    )
    classes = df.agg(F.countDistinct(col(spec.activity)).alias("activity_classes"))
    return _metrics(cases).unionByName(_metrics(classes))


def leaderboard(results: DataFrame, classifiers: list[str], horizons: int = 15) -> DataFrame:
    """One row per horizon, one column of AUC per classifier, in order."""
    return (
        results.filter(F.col("timediff") < horizons)
        .groupBy("timediff")
        .pivot("Classifier", classifiers)
        .agg(F.first("AUC", ignorenulls=True))
        .orderBy("timediff")
    )


__all__ = [
    "approvals_in_time", "describe", "equal_histogram", "frequencies",
    "last_event_business_days", "leaderboard", "log_statistics", "log_summary",
    "percentile_of_score", "range_shares", "remaining_by_state", "state_box",
    "state_outliers", "state_stats", "unit_histogram",
]
