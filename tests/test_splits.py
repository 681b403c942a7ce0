import pytest
from conftest import values
from pyspark.sql import functions as F

from dueline.operators import splits
from dueline.operators.ranges import group_percentiles, running_totals

# Ten cases; e, f and g share the time at the cut.
DAYS = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 5, "g": 5, "h": 8, "i": 9, "j": 10}
ROWS = [(c, "x", f"2024-01-{d:02d}") for c, d in DAYS.items()] + [
    ("a", "y", "2024-01-01 05:00:00"),
    ("b", "y", "2024-01-20"),
]


def test_temporal_split_breaks_ties_by_case(make_log):
    log = make_log([r for r in ROWS if r[0] != "b" or r[1] == "x"])
    got = splits.temporal_split(log.df, log.spec, 0.45, positions=True)
    parts = {r["case_id"]: (r["position"], r["part"]) for r in got.collect()}
    assert [parts[c][0] for c in DAYS] == list(range(10))
    # ceil(4.5) = 5 cases are for testing, so e is the last to train.
    assert "".join(c for c in DAYS if parts[c][1] == "test") == "fghij"


def test_cutoff_split(make_log):
    log = make_log(ROWS)
    train, test = splits.cutoff_split(log, 0.6)
    # Position 6 is g; its start also is the start of e and f.
    assert {r["case_id"] for r in test.df.collect()} == set("efghij")
    assert values(train.df, "case_id", "activity") == [
        ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("d", "x"),
    ]
    splits.assert_temporal_split(train.df, test.df, log.spec)
    with pytest.raises(AssertionError):
        leak = log.filter(F.col("ts") >= "2024-01-10").per_case(StartTime=F.min("ts"))
        splits.assert_temporal_split(log.df, leak.df, log.spec)


def test_random_split_is_repeatable(spark, make_log):
    spec = make_log(ROWS[:1]).spec
    cases = spark.range(20_000).select(F.col("id").cast("string").alias("case_id"))
    train, held = splits.random_split(cases, spec)
    again, _ = splits.random_split(cases.repartition(7), spec)
    assert values(train) == values(again)
    assert train.count() + held.count() == 20_000
    assert abs(train.count() / 20_000 - 0.8) < 0.02


def test_folds_are_even_by_label(spark, make_log):
    spec = make_log(ROWS[:1]).spec
    cases = spark.range(1003).select(
        F.col("id").cast("string").alias("case_id"), (F.col("id") % 7 == 0).cast("int").alias("y")
    )
    folds = splits.stratified_folds(cases, spec, "y", 5)
    sizes = folds.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r["y"] == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert values(folds) == values(splits.stratified_folds(cases.repartition(3), spec, "y", 5))


def test_running_totals_and_percentiles(spark):
    import pandas as pd

    pdf = pd.DataFrame({"g": ["u"] * 90 + ["v"] * 11, "x": [i * 7 % 13 / 3 for i in range(101)]})
    df = spark.createDataFrame(pdf)
    got = group_percentiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas()
    want = pdf.groupby("g")["x"].quantile([0.25, 0.5, 0.9]).unstack()
    for r in got.itertuples():
        assert [r.a, r.b, r.c] == pytest.approx(list(want.loc[r.g]))
    nums = spark.range(500).select(F.col("id").alias("k"), F.lit(2).alias("n"))
    out = running_totals(nums, [], "k", {"before": "n"}, {"all": "n"})
    assert out.filter("before != 2 * k OR all != 1000").count() == 0
