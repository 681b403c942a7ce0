import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from dueline.operators import encoding
from dueline.operators.encoding import CaseEncoder, CaseEncoderModel

ROWS = [
    ("a", "x", "2024-01-01", 2.0, "p", 1),
    ("a", "y", "2024-01-02", None, None, 1),
    ("a", "x", "2024-01-03", 5.0, "p", None),
    ("b", "y", "2024-01-01", 7.0, None, 0),
]
EXTRA = "v double, color string, y int"
ROLES = {"numeric": ("v",), "dynamic": ("activity", "color"), "static": ("color",)}


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(ROWS, EXTRA, **ROLES)


def test_columns_and_values(log):
    model = CaseEncoder.for_spec(log.spec).fit(log.df)
    assert model.columns == [
        "v_mean", "v_max", "v_min", "v_sum", "v_std",
        "activity_x", "activity_y", "activity_nan", "color_p", "color_nan", "color",
    ]
    assert model.static_positions == [10]
    got = {r["case_id"]: r for r in model.transform(log.df).collect()}
    a, b = got["a"], got["b"]
    # The null amount counts as 0; one event has no deviation.
    assert a["v_mean"] == pytest.approx(7 / 3) and a["v_min"] == 0
    assert a["v_std"] == pytest.approx(np.std([2, 0, 5], ddof=1)) and b["v_std"] == 0
    assert (a["activity_x"], a["activity_y"], a["activity_nan"]) == (2, 1, 0)
    assert (a["color_p"], a["color_nan"], a["color"]) == (2, 1, 0)
    assert (b["color_p"], b["color_nan"], b["color"]) == (0, 1, -1)
    # Last label that is known, although the last event has none.
    assert a["y"] == 1 and b["y"] == 0


def test_one_hot(log):
    with pytest.raises(ValueError, match="color_nan"):
        CaseEncoder.for_spec(log.spec, oneHotStatic=True).fit(log.df)
    spec = log.spec.but(dynamic=("activity",))
    model = CaseEncoder.for_spec(spec, oneHotStatic=True).fit(log.df)
    assert model.static_columns == ["color_-1", "color_0", "color_nan"]
    names = ["case_id", *model.static_columns]
    assert values(model.transform(log.df), *names) == [("a", 0, 1, 0), ("b", 1, 0, 0)]


def test_unknown_values_count_nowhere(log, make_log):
    model = CaseEncoder.for_spec(log.spec).fit(log.df)
    new = make_log([("c", "new", "2024-01-01", 1.0, "q", 0)], EXTRA, **ROLES)
    row = model.transform(new.df).first()
    assert row["color"] == -1
    assert sum(row[c] for c in model.dynamic_columns) == 0


def test_long_value_lists_give_the_same(log, monkeypatch):
    model = CaseEncoder.for_spec(log.spec).fit(log.df)
    direct = values(model.transform(log.df))
    monkeypatch.setattr(encoding, "_DIRECT_COLUMNS", 0)
    monkeypatch.setattr(encoding, "_LISTED_CODES", 0)
    assert values(model.transform(log.df)) == direct


def test_too_many_values_is_an_error(log):
    with pytest.raises(ValueError, match="dynamic_counts"):
        CaseEncoder.for_spec(log.spec, maxValues=2).fit(log.df)
    counts = encoding.dynamic_counts(log.df, log.spec)
    assert counts.agg(F.sum("n")).first()[0] == len(ROWS) * 2


def test_saved_model(log, tmp_path):
    model = CaseEncoder.for_spec(log.spec).fit(log.df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = CaseEncoderModel.load(str(tmp_path / "m"))
    assert values(again.transform(log.df)) == values(model.transform(log.df))


def test_numbers_sort_as_numbers(make_log):
    rows = [("a", "x", "2024-01-01", 10), ("b", "x", "2024-01-01", 9), ("c", "x", "2024-01-01", -1)]
    log = make_log(rows, "k int", static=("k",))
    model = CaseEncoder.for_spec(log.spec, labelCol="").fit(log.df)
    codes = dict(pd.Series([10, 9, -1], index=["a", "b", "c"]).astype("category").cat.codes)
    assert dict(values(model.transform(log.df), "case_id", "k")) == codes


def test_feature_cardinality(log):
    rows = CaseEncoder.for_spec(log.spec).fit(log.df).transform(log.df)
    got = encoding.feature_cardinality(rows, ["color"]).first()
    assert (got["n_values"], got["embedding_size"]) == (2, 2)
