"""Closed forms against pandas and numpy over random pairs of moments."""

import datetime

import numpy as np
import pandas as pd
from pandas.tseries.offsets import BusinessDay
from pyspark.sql import functions as F

from dueline.functions import calendar, timing

N = 3000


def moments():
    rng = np.random.default_rng(7)
    base = np.datetime64("2015-01-01T00:00:00", "us")
    a = base + rng.integers(0, 365 * 86_400 * 10**6, N).astype("timedelta64[us]")
    b = a + rng.integers(-20 * 86_400 * 10**6, 20 * 86_400 * 10**6, N).astype("timedelta64[us]")
    whole = rng.random(N) < 0.3
    a = np.where(whole, a.astype("datetime64[D]").astype("datetime64[us]"), a)
    b = np.where(rng.random(N) < 0.3, b.astype("datetime64[D]").astype("datetime64[us]"), b)
    return pd.DataFrame({"i": range(N), "a": a, "b": b, "k": rng.integers(0, 16, N)})


def test_against_pandas(spark):
    pdf = moments()
    df = spark.createDataFrame(pdf).select(
        "i", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"), "k"
    )
    got = (
        df.select(
            "i",
            calendar.minus_business_days(F.col("b"), F.col("k")).alias("offset"),
            calendar.business_days_between(F.col("a"), F.col("b")).alias("between"),
            calendar.business_days_left(F.col("a"), F.col("b")).alias("left"),
            calendar.friday_on_or_after(F.col("a")).alias("friday"),
            calendar.workday_steps(F.col("a"), F.col("b")).alias("steps"),
            timing.whole_days_between(F.col("a"), F.col("b")).alias("days"),
        )
        .toPandas()
        .sort_values("i")
        .reset_index(drop=True)
    )
    offset = [b - BusinessDay(int(k)) for b, k in zip(pdf.b, pdf.k, strict=True)]
    assert (got.offset == pd.Series(offset)).all()
    day = "datetime64[D]"
    between = np.busday_count(pdf.a.values.astype(day), pdf.b.values.astype(day))
    assert (got.between.values == between).all()
    left = [len(pd.date_range(a, b, freq="B")) - 1 for a, b in zip(pdf.a, pdf.b, strict=True)]
    assert (got.left.values == np.array(left)).all()
    friday = [a + pd.Timedelta(days=(4 - a.weekday()) % 7) for a in pdf.a]
    assert (got.friday == pd.Series(friday)).all()
    assert (got.days.values == (pdf.b - pdf.a).dt.days.values).all()
    for i, (a, b, s) in enumerate(zip(pdf.a, pdf.b, got.steps, strict=True)):
        if s >= 0:
            assert a <= b - BusinessDay(int(s)), i
        assert a > b - BusinessDay(int(max(s + 1, 0))), i


def test_weekend_and_null(spark):
    rows = [(d,) for d in ["2024-03-04", "2024-03-08", "2024-03-09", "2024-03-10", None]]
    df = spark.createDataFrame(rows, "d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = df.select(
        "d",
        *[calendar.minus_business_days(F.col("d"), k).alias(f"k{k}") for k in (0, 1, 5, 7)],
        calendar.friday_on_or_after(F.col("d")).alias("friday"),
    ).collect()
    saturday = got[2]
    assert str(saturday["k0"].date()) == "2024-03-11"
    assert str(saturday["k1"].date()) == "2024-03-08"
    assert str(got[0]["k1"].date()) == "2024-03-01"
    assert str(got[3]["k5"].date()) == "2024-03-04"
    assert str(saturday["friday"].date()) == "2024-03-15"
    assert got[4]["k1"] is None and got[4]["friday"] is None


def test_holidays_against_numpy_and_pandas(spark):
    rng = np.random.default_rng(9)
    days = np.datetime64("2015-01-01") + np.sort(rng.choice(500, 60, replace=False)).astype("timedelta64[D]")
    off = calendar.Holidays([d.item() for d in days])
    pdf = moments()
    df = spark.createDataFrame(pdf).select(
        "i", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"), "k"
    )
    made = df.select(
        "i",
        calendar.minus_business_days(F.col("a"), F.col("k"), off).alias("earlier"),
        calendar.business_days_between(F.col("a"), F.col("b"), off).alias("between"),
        calendar.business_days_left(F.col("a"), F.col("b"), off).alias("left"),
        calendar.business_days_between(F.col("a"), F.col("b"), calendar.Holidays([])).alias("plain"),
    )
    got = made.toPandas().sort_values("i").reset_index(drop=True)
    a, b = (pdf[c].to_numpy().astype("datetime64[D]") for c in "ab")
    rolled = np.busday_offset(a, -pdf["k"].to_numpy(), roll="forward", holidays=days)
    assert (got["earlier"].to_numpy().astype("datetime64[D]") == rolled).all()
    assert (got["between"].to_numpy() == np.busday_count(a, b, holidays=days)).all()
    assert (got["plain"].to_numpy() == np.busday_count(a, b)).all()
    step = pd.offsets.CustomBusinessDay(holidays=list(days))
    for i in range(0, N, 6):
        want = len(pd.date_range(pdf["a"][i], pdf["b"][i], freq=step)) - 1
        assert got["left"][i] == want, (pdf["a"][i], pdf["b"][i])


def test_holidays_are_a_constant(spark):
    """The tables are folded: no join, one literal."""
    off = calendar.Holidays([datetime.date(2020, 1, 1), datetime.date(2024, 12, 25)])
    made = spark.range(3).select(calendar.minus_business_days(F.lit("2024-12-27").cast("timestamp_ntz") , F.col("id").cast("int"), off).alias("m"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "split(" not in plan
    assert [r.m.day for r in made.collect()] == [27, 26, 24]
