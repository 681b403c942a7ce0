import random

import pytest
from conftest import SMALL, at, values
from pyspark.sql import functions as F

from dueline import CaseLog
from dueline.operators import horizons
from dueline.plans import matrices
from dueline.sources.cache import content_key
from dueline.sources.tables import is_complete

SPEC = SMALL.but(deadline="deadline", numeric=("v",), dynamic=("activity",))
SCHEMA = (
    "case_id string, activity string, ts timestamp_ntz, nr int, v double, y int, deadline timestamp_ntz"
)


def _write(spark, path, seed):
    draw = random.Random(seed)
    rows = [
        (f"c{draw.randint(0, 9)}", draw.choice("ab"), at(f"2024-03-{draw.randint(1, 20):02d}"), i,
         draw.random(), draw.randint(0, 1), at("2024-03-15"))
        for i in range(60)
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def _made(spark, path, place, count=3, spec=SPEC):
    df = spark.read.parquet(path)
    cases = df.select("case_id").distinct()
    first = F.col("case_id") < "c5"
    sides = cases.filter(first), cases.filter(~first)
    return matrices.horizon_matrices(CaseLog.of(df, spec), range(count), *sides, place)


def test_unchanged_input_is_read_back_and_changed_input_is_not(spark, tmp_path, monkeypatch):
    path, place = str(tmp_path / "my log"), str(tmp_path / "kept")
    _write(spark, path, 1)
    one = _made(spark, path, place)
    assert one.built
    before = [values(one.rows("train", h)) for h in range(3)]
    assert before[0] and [m.columns for m in one.models.values()]

    def fails(*_, **__):
        raise AssertionError("the log is read again")

    with monkeypatch.context() as patched:
        patched.setattr(matrices.sweep, "fit_horizons", fails)
        patched.setattr(matrices.sweep, "horizon_rows", fails)
        again = _made(spark, path, place)
        assert not again.built and again.path == one.path
        assert [m.columns for m in again.models.values()] == [m.columns for m in one.models.values()]
        assert [values(again.rows("train", h)) for h in range(3)] == before
        for other in ({"count": 4}, {"spec": SPEC.but(numeric=())}):
            with pytest.raises(AssertionError, match="read again"):
                _made(spark, path, place, **other)

    _write(spark, path, 2)
    changed = _made(spark, path, place)
    assert changed.built and changed.path != one.path
    models = horizons.fit_horizons(
        spark.read.parquet(path).filter("case_id < 'c5'"), SPEC, range(3), oneHotStatic=True
    )
    rows = horizons.horizon_rows(spark.read.parquet(path).filter("case_id < 'c5'"), SPEC, models)
    want = horizons.at_horizon(rows, SPEC, 1, models)
    assert values(changed.rows("train", 1)) == values(want)


def test_a_write_that_broke_off_is_built_again(spark, tmp_path, monkeypatch):
    path, place = str(tmp_path / "log"), str(tmp_path / "kept")
    _write(spark, path, 1)
    monkeypatch.setattr(matrices.sweep, "horizon_rows", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        _made(spark, path, place)
    monkeypatch.undo()
    made = _made(spark, path, place)
    assert made.built and is_complete(spark, f"{made.path}/table")


def test_key_follows_plan_columns_files_and_rows_at_hand(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    _write(spark, a, 1)
    _write(spark, b, 1)
    left, right = spark.read.parquet(a), spark.read.parquet(b)

    def key(*inputs, **settings):
        return content_key(list(inputs), settings)

    assert key(left) == key(spark.read.parquet(a))
    listed = "select * from values ({}) t(x)"
    different = [
        key(left), key(right), key(left, right), key(right, left), key(left, x=1), key(left, x=2),
        key(left.filter("v > 0.5")), key(left.filter("v > 0.25")), key(left.withColumnRenamed("v", "w")),
        key(left.union(right)), key(right.union(left)),
        key(spark.sql(listed.format(1))), key(spark.sql(listed.format(2))),
    ]
    assert len(set(different)) == len(different)
    assert key(spark.sql(listed.format(1))) == different[-2]
    held = spark.createDataFrame([(1,)], "x int")
    assert key(held) != key(held)


def test_a_row_of_many_horizons_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"c{i}", "a", at("2024-03-01"), i, 1.0, 0, at("2024-03-29")) for i in range(10)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    made = _made(spark, path, str(tmp_path / "kept"), 15)
    assert spark.read.parquet(f"{made.path}/table").count() == 10
    assert all(made.rows(s, h).count() == 5 for s in ("train", "test") for h in range(15))
