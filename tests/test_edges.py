"""Inputs at the edge of what the operators take."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dueline import CaseLog
from dueline.functions import calendar
from dueline.operators import cutting
from dueline.operators.encoding import CaseEncoder
from dueline.plans import reports
from dueline.sources.tables import read_or_build
from dueline.sources.xes import common_kind

from conftest import SMALL


@pytest.mark.parametrize("values", [[3, 3, 3], [0.1, 0.5, 0.9], [-2, 7, 1, 1, 0], [2.5, None, 4.0, float("nan")]])
def test_equal_bins_are_numpys(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    got = [r.n for r in reports.equal_histogram(df, "v", 4).orderBy("bin").collect()]
    real = [float(v) for v in values if v is not None and v == v]
    assert got == np.histogram(real, 4)[0].tolist()


def test_business_days_before_1900(spark):
    days = [date(1899, 12, 20) + timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    got = df.select("a", "b", calendar.business_days_between(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        if r.a <= r.b:
            assert r.n == np.busday_count(r.a, r.b)
    fridays = df.select("a", calendar.friday_on_or_after(F.col("a").cast("timestamp_ntz")).alias("f"))
    assert all(r.f.weekday() == 4 and 0 <= (r.f.date() - r.a).days < 7 for r in fridays.collect())


def test_no_number_counts_as_zero(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, float("nan")), ("a", "y", 2, 4.0), ("b", "x", 1, None)],
        "case_id string, activity string, nr int, v double",
    )
    encoder = CaseEncoder(caseCol="case_id", orderBy=["nr"], numericCols=["v"], labelCol="")
    got = {r.case_id: (r.v_sum, r.v_max, r.v_mean) for r in encoder.fit(df).transform(df).collect()}
    assert got == {"a": (4.0, 4.0, 2.0), "b": (0.0, 0.0, 0.0)}


def test_wide_counts_keep_rows_without_a_case(spark):
    rows = [(None, f"v{i}", i) for i in range(3)] + [("a", f"v{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "case_id string, activity string, nr int")
    encoder = CaseEncoder(caseCol="case_id", orderBy=["nr"], dynamicCols=["activity"], labelCol="")
    got = encoder.fit(df).transform(df)
    assert {r.case_id for r in got.select("case_id").collect()} == {None, "a"}


def test_long_cases_keep_the_order_of_columns(spark, make_log):
    rows = [("a", "x", "2024-01-01 00:00:00")] * 9 + [("b", "x", "2024-01-01 00:00:00")]
    log = make_log(rows)
    long = CaseLog.of(log.df.select("nr", "activity", "case_id", "ts"), SMALL.but(long_case_events=4))
    assert long.long is not None and long.df.columns == ["nr", "activity", "case_id", "ts"]


def test_row_wise_steps_start_no_job(spark, make_log):
    log = make_log([("a", "x", "2024-01-01"), (None, "x", "2024-01-01"), ("a", None, None)])
    context = spark.sparkContext
    context.setJobGroup("narrow", "row-wise steps")
    kept = log.filter(F.col("activity") == "x").with_columns({"twice": F.col("nr") * 2}).with_spec(dynamic=())
    plan = kept.df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert not context.statusTracker().getJobIdsForGroup("narrow")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert kept.df.count() == 1 and kept.in_order(number="n").df.count() == 1


def test_sweep_of_an_empty_horizon(spark):
    spec = SMALL.but(deadline="due")
    start = datetime(2024, 3, 4, 9)
    df = spark.createDataFrame(
        [("a", "x", start, 0, start + timedelta(days=1), 2.0)],
        "case_id string, activity string, ts timestamp_ntz, nr int, due timestamp_ntz, v double",
    )
    got = cutting.horizon_sweep(df, spec, 4, ("v",)).orderBy("horizon").collect()
    assert [(r.n_cases, r.n_events, r.sum_v) for r in got] == [(1, 1, 2.0), (1, 1, 2.0), (0, 0, None), (0, 0, None)]


def test_kinds_of_one_attribute():
    assert common_kind({"int"}) == "int"
    assert common_kind({"int", "float"}) == "float"
    assert common_kind({"int", "date"}) == "string"


def test_broken_write_is_built_again(spark, tmp_path):
    path, built = f"{tmp_path}/t", []

    def build():
        built.append(1)
        return spark.range(3)

    assert read_or_build(spark, path, build).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert read_or_build(spark, path, build).count() == 3
    assert read_or_build(spark, path, build).count() == 3 and len(built) == 2


def test_description_of_many_values_and_of_none(spark):
    rows = spark.range(1001).select((F.col("id") * 37 % 1001).alias("v"))
    with_nulls = rows.union(spark.sql("select cast(null as bigint)"))
    assert tuple(reports.describe(with_nulls, "v").first())[:2] == (1001, 500.0)
    assert tuple(reports.describe(with_nulls, "v").first())[3:] == (0, 250.0, 500.0, 750.0, 1000)
    assert tuple(reports.describe(rows.limit(0), "v").first()) == (0, *[None] * 7)
