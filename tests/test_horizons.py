import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from dueline.operators import horizons
from dueline.operators.cutting import cut_before_deadline
from dueline.operators.encoding import CaseEncoder
from dueline.plans.case_queries import labelled_orders

ROLES = {"numeric": ("v",), "dynamic": ("activity", "color"), "static": ("kind",)}
EXTRA = "v double, color string, kind string, y int, deadline timestamp_ntz"


@pytest.fixture(scope="module")
def log(make_log):
    draw = random.Random(5)
    rows = []
    for c in range(24):
        due = at(f"2024-03-{draw.randint(1, 28):02d}T{draw.choice(['00:00', '13:30'])}")
        for _ in range(draw.randint(1, 9)):
            when = f"2024-{draw.choice(['02', '03'])}-{draw.randint(1, 28):02d}T{draw.randint(0, 23):02d}:00"
            rows.append((
                f"c{c}", draw.choice("abcdefgh"), draw.choice([when, when, when, None]),
                draw.choice([None, float("nan"), 1e9 + draw.random(), draw.random()]),
                draw.choice([None, "p", "q", "r"]), draw.choice([None, "k", "l", "m"]), draw.choice([None, 0, 1]), draw.choice([due, due, None]),
            ))
    return make_log(rows, EXTRA, deadline="deadline", **ROLES)


def _same(got, want):
    assert got.columns == want.columns
    a, b = (sorted((tuple(r) for r in df.collect()), key=lambda r: str(r[0])) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == (pytest.approx(v, rel=1e-9, abs=1e-6) if isinstance(v, float) else v)


@pytest.mark.parametrize(("one_hot", "many"), [(False, range(15)), (True, (9, 0, 4, 4000))])
def test_all_horizons_equal_encodings_one_by_one(log, one_hot, many):
    train = log.filter(F.col("case_id") < "c18")
    models = horizons.fit_horizons(train.df, log.spec, many, oneHotStatic=one_hot)
    rows = horizons.horizon_rows(log.df, log.spec, models).persist()
    left = 0
    for h in many:
        own = CaseEncoder.for_spec(log.spec, oneHotStatic=one_hot).fit(cut_before_deadline(train, h).df)
        assert own.columns == models[h].columns
        want = own.transform(cut_before_deadline(log, h).df)
        left += want.count()
        _same(horizons.at_horizon(rows, log.spec, h, models), want)
    assert rows.count() == left > 0


def test_long_value_lists_are_counted_as_pairs(log, monkeypatch):
    models = horizons.fit_horizons(log.df, log.spec, range(4))
    direct = horizons.horizon_rows(log.df, log.spec, models)
    monkeypatch.setattr(horizons, "_DIRECT_COLUMNS", 2)
    wide = horizons.horizon_rows(log.df, log.spec, models)
    assert wide.columns == direct.columns
    assert wide.count() == direct.count()
    counted = ["case_id", "horizon", *models[0].dynamic_columns]
    assert wide.select(*counted).exceptAll(direct.select(*counted)).isEmpty()


def test_no_event_left_and_too_many_values(log):
    none = log.filter(F.lit(False))
    models = horizons.fit_horizons(none.df, log.spec, range(3))
    assert horizons.horizon_rows(none.df, log.spec, models).isEmpty()
    with pytest.raises(ValueError, match="more than 2"):
        horizons.fit_horizons(log.df, log.spec, range(3), maxValues=2)


def test_log_is_scanned_once(spark, folder):
    log = labelled_orders(spark, folder)
    models = horizons.fit_horizons(log.df, log.spec, range(15))
    one = CaseEncoder.for_spec(log.spec).fit(log.df).transform(log.df)
    rows = horizons.horizon_rows(log.df, log.spec, models)

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    assert scans(rows) == scans(one)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "Python" not in text


def test_merged_rows_stand_once_for_horizons_at_which_they_are_the_same(log, monkeypatch):
    models = horizons.fit_horizons(log.df, log.spec, range(15))
    rows = horizons.horizon_rows(log.df, log.spec, models).persist()
    reached = horizons.with_reach(log.df, log.spec, list(range(15)))
    pairs = reached.select("case_id", "_reach").distinct().count()
    assert pairs < rows.count()
    for direct in (200, 0):
        monkeypatch.setattr(horizons, "_DIRECT_COLUMNS", direct)
        merged = horizons.horizon_rows(log.df, log.spec, models, merged=True).persist()
        assert merged.count() == pairs
        for h in (0, 6, 14):
            _same(
                horizons.at_horizon(merged, log.spec, h, models), horizons.at_horizon(rows, log.spec, h, models)
            )
        merged.unpersist()
    rows.unpersist()
