"""Cases above the limit give the same values as all cases by plain windows."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from dueline import CaseLog
from dueline.operators import cutting, encoding, features, filters, splits
from dueline.operators.labeling import late_payment_label
from dueline.operators.ranges import RANGE
from dueline.plans import reports
from dueline.sources import samples


@pytest.fixture(scope="module")
def logs(spark, folder):
    """Click log with one user holding a third of all events, twice."""
    events = samples.click_events(spark, folder)
    third = F.when(F.xxhash64("ts") % 3 == 0, F.lit(999)).otherwise(F.col("case_id"))
    skewed = events.withColumn("case_id", third.cast("long")).withColumn(
        "deadline", F.lit("2024-01-23").cast("timestamp_ntz")
    )
    spec = samples.CLICK_SPEC
    plain = CaseLog.of(skewed, spec)
    split = CaseLog.of(skewed, spec.but(long_case_events=50))
    assert plain.long is None and split.long is not None
    assert split.long.select(RANGE).distinct().count() > 2
    assert 0 < split.long.count() < skewed.count()
    assert values(plain.df, "case_id", "ts") == values(split.df, "case_id", "ts")
    return plain, split


STEPS = {
    "numbers": features.event_number,
    "duration": features.event_duration,
    "since last": features.time_since_last_event,
    "since first": features.time_since_first_event,
    "cumulative": features.cumulative_duration,
    "total": features.total_duration,
    "remaining": features.remaining_time,
    "business": features.remaining_business_days,
    "length": features.trace_length,
    "count": lambda log: features.activity_count(log, "click"),
    "start": features.case_start,
    "last": lambda log: features.spread_last(log, "value"),
    "label": lambda log: late_payment_label(log, "purchase", "error"),
    "state": lambda log: cutting.cut_at_state(log, "signup"),
    "cut": lambda log: cutting.cut_before_deadline(log, 3),
    "min": lambda log: filters.min_activity(log, "click", 12),
    "meets": lambda log: filters.cases_intersecting(log, "2024-01-02", "2024-01-03"),
    "starting": lambda log: filters.cases_starting_in(log, "2024-01-01", "2024-01-01 12:00:00"),
    "ending": lambda log: filters.cases_ending_in(log, "2024-01-30", "2024-01-31"),
    "neighbours": lambda log: log.in_order(
        "n", {"before": "value", "before_type": "activity"}, {"after": "value"}
    ),
    "joined": lambda log: log.join_cases(
        log.df.groupBy("case_id").agg(F.max("value").alias("top")).filter("case_id > 3")
    ),
    "kept": lambda log: log.keep_cases(
        log.df.filter("case_id % 2 = 1").select("case_id").distinct()
    ),
}


@pytest.mark.parametrize("name", STEPS)
def test_same_as_plain(logs, name):
    plain, split = (STEPS[name](log) for log in logs)
    assert split.df.columns == plain.df.columns == plain.columns
    assert values(plain.df) == values(split.df)


def test_chain_and_reports(logs):
    results = []
    for log in logs:
        log = late_payment_label(features.event_number(log), "purchase", "error")
        by_state = reports.remaining_by_state(log, samples.CLICK_STATES)
        cut = cutting.cut_before_deadline(log, 2)
        rows = encoding.CaseEncoder.for_spec(log.spec).fit(cut.df).transform(cut.df)
        train, test = splits.cutoff_split(log)
        results.append(
            [
                values(by_state.withColumn("remaining", F.round("remaining", 6))),
                values(rows.select("case_id", "y", "activity_click", "activity_nan")),
                values(train.df, "case_id", "ts"),
                values(test.df, "case_id", "ts"),
            ]
        )
    assert results[0] == results[1]


def test_one_moment(spark):
    """A long case whose events all share one time is still cut into ranges."""
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, F.lit("big")).otherwise(F.col("id").cast("string")).alias("case_id"),
        F.lit("a").alias("activity"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("nr"),
    )
    from conftest import SMALL

    log = CaseLog.of(df, SMALL.but(long_case_events=100))
    sizes = [r["count"] for r in log.long.groupBy(RANGE).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 400
    got = features.event_number(log).df.filter("case_id = 'big'")
    assert got.filter("event_nr != nr + 1").count() == 0
