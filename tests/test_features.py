"""Hand-written logs for what the test tables lack."""

import pytest
from conftest import values

from dueline.operators import cutting, features, filters
from dueline.operators.labeling import late_payment_label

ONE = [("a", "x", "2024-01-01 10:00:00")]
# Two cases, events alternating in the table.
INTERLEAVED = [
    ("a", "x", "2024-01-01 00:00:00"),
    ("b", "x", "2024-01-01 01:00:00"),
    ("a", "y", "2024-01-01 06:00:00"),
    ("b", "y", "2024-01-02 01:00:00"),
    ("a", "z", "2024-01-02 00:00:00"),
]


def test_one_event(make_log):
    log = make_log(ONE)
    for step in (
        features.event_duration, features.total_duration, features.remaining_time,
        features.cumulative_duration, features.time_since_last_event,
        features.time_since_first_event, features.event_number, features.trace_length,
    ):
        log = step(log)
    got = log.df.first()
    assert got["duration"] is None and got["cumulative_duration"] is None
    assert got["total_duration"] == 0 and got["remaining_time"] == 0
    assert got["time_since_last_event"] == 0 and got["time_since_first_event"] == 0
    assert got["event_nr"] == 1 and got["trace_length"] == 1


def test_interleaved_cases_do_not_mix(make_log):
    log = features.cumulative_duration(features.event_duration(make_log(INTERLEAVED)))
    log = features.time_since_last_event(features.total_duration(log))
    assert values(log.df, "case_id", "activity", "duration", "cumulative_duration", "time_since_last_event", "total_duration") == [
        ("a", "x", 6.0, 6.0, 0.0, 24.0),
        ("a", "y", 18.0, 24.0, 21600.0, 24.0),
        ("a", "z", None, None, 64800.0, 24.0),
        ("b", "x", 24.0, 24.0, 0.0, 24.0),
        ("b", "y", None, None, 86400.0, 24.0),
    ]


def test_elapsed_and_remaining_add_up(make_log):
    log = features.remaining_time(features.time_since_first_event(make_log(INTERLEAVED)))
    log = features.total_duration(log)
    for r in log.df.collect():
        assert r["time_since_first_event"] / 3600 + r["remaining_time"] * 24 == pytest.approx(
            r["total_duration"]
        )


def test_night_shift(make_log):
    """Monday 23:00 to Tuesday 01:00: no full day, one workday."""
    log = make_log([("a", "x", "2024-03-04 23:00:00"), ("a", "y", "2024-03-05 01:00:00")])
    row = features.remaining_business_days(log).df.orderBy("ts").first()
    assert (row["days_count"], row["bus_days_between"], row["holidays"]) == (0, 1, -1)
    assert row[features.REMAINING_BUSINESS_TIME] == pytest.approx(2 / 24 + 1)


def test_missing_activity_counts_zero(make_log):
    log = features.activity_count(make_log(INTERLEAVED), "nowhere")
    assert {r["Count nowhere"] for r in log.df.collect()} == {0}
    kept = filters.min_activity(make_log(INTERLEAVED), "z", 1)
    assert {r["case_id"] for r in kept.df.collect()} == {"a"}


LABELS = [
    ("none", "x", "2024-01-01"),
    ("none", "x", "2024-01-02"),
    ("begin", "begin payment", "2024-01-01"),
    ("begin", "x", "2024-01-02"),
    ("aborted", "begin payment", "2024-01-01"),
    ("aborted", "abort payment", "2024-01-02"),
    ("aborted", "x", "2024-01-03"),
    ("again", "abort payment", "2024-01-01"),
    ("again", "begin payment", "2024-01-02"),
    ("again", "x", "2024-01-03"),
]


def test_late_label(make_log):
    log = late_payment_label(make_log(LABELS))
    assert "event_nr" not in log.columns
    assert sorted(set(values(log.df, "case_id", "y", "pos"))) == [
        ("aborted", 1, 3), ("again", 0, 2), ("begin", 0, 1), ("none", 1, 2),
    ]


def test_cut_at_state(make_log):
    log = cutting.cut_at_state(make_log(INTERLEAVED), "y")
    assert values(log.df, "case_id", "activity", "state") == [
        ("a", "x", 2), ("a", "y", 2), ("b", "x", 2), ("b", "y", 2),
    ]
    assert cutting.cut_at_state(make_log(INTERLEAVED), "z").df.select("case_id").distinct().count() == 1


def test_cut_before_deadline_shrinks_and_keeps_the_limit(make_log):
    rows = [("a", str(d), f"2024-03-{d:02d} 12:00:00") for d in range(1, 20)]
    log = make_log(rows)
    from pyspark.sql import functions as F

    log = log.with_columns({"deadline": F.lit("2024-03-17 12:00:00").cast("timestamp_ntz")})
    counts = [cutting.cut_before_deadline(log, k).df.count() for k in range(8)]
    # Sunday the 17th: Monday 18th, Friday 15th, 14th, .., 11th, 8th, 7th.
    assert counts == [18, 15, 14, 13, 12, 11, 8, 7]
    sweep = {r["horizon"]: r["n_events"] for r in cutting.horizon_sweep(log.df, log.spec, 8).collect()}
    assert [sweep[k] for k in range(8)] == counts


def test_null_case_is_left_out_and_columns_are_checked(make_log, spark):
    from conftest import SMALL

    from dueline import CaseLog

    assert make_log([*ONE, (None, "x", "2024-01-01")]).df.count() == 1
    with pytest.raises(ValueError, match="missing"):
        CaseLog.of(spark.range(3), SMALL)


def test_spread_last_skips_nulls(make_log):
    rows = [("a", "x", "2024-01-01", True), ("a", "y", "2024-01-02", None)]
    log = features.spread_last(make_log(rows, "late boolean"), "late")
    assert [r["late"] for r in log.df.collect()] == [True, True]
