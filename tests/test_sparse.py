"""Sparse vectors hold what the explicit columns hold, for any number of values."""

import pytest
from pyspark.sql import functions as F

from dueline.models import tuning
from dueline.operators import sparse
from dueline.operators.encoding import CaseEncoder

ROWS = [
    ("a", "x", "2024-01-01", 2.0, "p", 1),
    ("a", "nan", "2024-01-02", None, None, 1),
    ("a", "x", "2024-01-03", float("nan"), "p", None),
    ("b", None, "2024-01-01", 0.0, None, 0),
    (None, "x", "2024-01-01", 7.0, "q", 0),
]
EXTRA = "v double, color string, y int"
ROLES = {"numeric": ("v",), "dynamic": ("activity", "color"), "static": ("color",)}


def by_name(rows, log, slots):
    found = {}
    for r in sparse.filled_slots(rows, log.spec, slots).collect():
        found[(r["case_id"], r["role"], r["column"], r["value"])] = r["x"]
    return found


def test_values_and_slots(make_log):
    log = make_log(ROWS, EXTRA, **ROLES)
    slots = sparse.learn_slots(log.df, log.spec)
    # Five numbers; x, a literal nan and null; p and null; the same as flags.
    assert slots.size == 5 + 3 + 2 + 2
    rows = sparse.encode_sparse(log.df, log.spec, slots)
    got = by_name(rows, log, slots)
    assert got[("a", 0, "v", "sum")] == 2 and got[("a", 0, "v", "max")] == 2
    assert got[("a", 0, "v", "mean")] == pytest.approx(2 / 3)
    assert got[("a", 1, "activity", "x")] == 2 and got[("a", 1, "activity", "nan")] == 1
    assert got[("b", 1, "activity", None)] == 1 and got[("b", 2, "color", None)] == 1
    assert got[("a", 1, "color", None)] == 1 and got[("a", 2, "color", "p")] == 1
    assert not [k for k in got if k[0] == "b" and k[1] == 0]
    # A row without a case is no case; the label is the last one known.
    assert {r["case_id"]: r["y"] for r in rows.collect()} == {"a": 1, "b": 0}


def test_as_explicit_columns(make_log):
    log = make_log([r for r in ROWS if r[0] and r[1] != "nan"], EXTRA, **ROLES).with_spec(static=())
    slots = sparse.learn_slots(log.df, log.spec)
    vectors = {r["case_id"]: r[sparse.FEATURES] for r in sparse.encode_sparse(log.df, log.spec, slots).collect()}
    model = CaseEncoder.for_spec(log.spec).fit(log.df)
    for r in model.transform(log.df).collect():
        explicit = sorted(r[c] for c in model.columns)
        assert sorted(vectors[r["case_id"]].toArray()) == pytest.approx(explicit)


def test_unknown_values_and_empty_roles(make_log):
    log = make_log(ROWS, EXTRA, **ROLES)
    slots = sparse.learn_slots(log.df, log.spec)
    new = make_log([("c", "new", "2024-01-01", 0.0, "z", 0)], EXTRA, **ROLES)
    assert sparse.encode_sparse(new.df, log.spec, slots).first()[sparse.FEATURES].numNonzeros() == 0
    bare = log.spec.but(numeric=(), dynamic=(), static=())
    none = sparse.learn_slots(log.df, bare)
    assert none.size == 0 and sparse.encode_sparse(log.df, bare, none).count() == 2


def test_more_values_than_columns_would_hold(spark):
    from conftest import SMALL

    n = 30_000
    df = spark.range(n).select(
        (F.col("id") % 500).cast("string").alias("case_id"),
        F.concat(F.lit("r"), F.col("id")).alias("activity"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.col("id").cast("int").alias("nr"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    spec = SMALL.but(dynamic=("activity",), order_by=("nr",))
    with pytest.raises(ValueError, match="more than"):
        CaseEncoder.for_spec(spec).fit(df)
    slots = sparse.learn_slots(df, spec)
    assert slots.size == n
    rows = sparse.encode_sparse(df, spec, slots)
    found = tuning.fit_one(rows, spec, [sparse.FEATURES], "LogisticRegression", {"C": 1.0})
    assert tuning.score(found, rows, spec).filter("p between 0 and 1").count() == 500


def test_a_log_that_lies_by_case_stays_there(make_log):
    log = make_log(ROWS, EXTRA, **ROLES)
    slots = sparse.learn_slots(log.df, log.spec)
    # One exchange of the rows for each of the two aggregates, none of counts or lists.
    placed = log.df.repartition(3, "case_id")
    plan = sparse.stored_vectors(placed, log.spec, slots)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Expand" not in plan


def test_slots_too_many_to_broadcast(make_log, monkeypatch):
    log = make_log(ROWS, EXTRA, **ROLES)
    slots = sparse.learn_slots(log.df, log.spec)
    sent = by_name(sparse.encode_sparse(log.df, log.spec, slots), log, slots)
    monkeypatch.setattr(sparse, "_BROADCAST_SLOTS", 0)
    assert by_name(sparse.encode_sparse(log.df, log.spec, slots), log, slots) == sent and sent


def test_wide_model_encodes_once(spark, folder, monkeypatch):
    from dueline.plans import model_queries

    calls, real = [], sparse.encode_sparse
    monkeypatch.setattr(sparse, "encode_sparse", lambda *a: calls.append(1) or real(*a))
    assert model_queries.model_wide(spark, folder).first()["auc_agrees"] and len(calls) == 1


def test_linear_fits_have_few_tasks_for_many_rows(spark):
    from conftest import SMALL

    most = tuning._TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, most + 10)
    placed = tuning._placed(rows, SMALL, "LogisticRegression", 10**9)
    assert placed.rdd.getNumPartitions() == most
