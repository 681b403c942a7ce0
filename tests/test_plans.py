"""The physical plans are the ones intended."""

import re

from pyspark.sql import functions as F

from dueline.operators import cutting, encoding, features
from dueline.plans.catalog import QUERIES, SQL
from dueline.sources import samples


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan(df)))


def test_all_event_features_share_one_shuffle(spark, folder):
    log = samples.click_log(spark, folder).numbered()
    for step in (
        features.event_duration, features.time_since_last_event, features.total_duration,
        features.time_since_first_event, features.remaining_business_days,
        features.trace_length, features.time_attributes,
    ):
        log = step(log)
    assert shuffles(log.df) == 1


def test_label_cut_and_encoding_share_one_shuffle(spark, folder):
    df = QUERIES["case_features"](spark, folder)
    text = plan(df)
    assert shuffles(df) == 1
    assert "SortAggregate" not in text and "HashAggregate" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scan_reads_what_is_used(spark, folder):
    log = samples.click_log(spark, folder).filter(F.col("activity") == "view")
    text = plan(log.df.groupBy("case_id").agg(F.max("ts")))
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema and "value" not in schema
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,view\)", text)


def test_time_cut_is_row_by_row(spark, folder):
    log = samples.click_log_with_deadline(spark, folder)
    assert shuffles(cutting.cut_before_deadline(log, 3).df) == 0


def test_numeric_encoding_combines_before_the_shuffle(spark, folder):
    log = samples.click_log(spark, folder).with_spec(dynamic=())
    encoder = encoding.CaseEncoder.for_spec(log.spec, labelCol="")
    text = plan(encoder.fit(log.df).transform(log.df))
    assert "partial_avg" in text and text.count("Exchange hashpartitioning") == 1


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    searches = {"linear", "tree", "forest", "boosted", "network"}
    families = {"lr", "dt", "rf", "gbt", "svm", "mlp", "roundtrip"}
    assert set(QUERIES) - set(SQL) == {
        "random_split", "fold_assign", *(f"grid_{x}" for x in searches), *(f"model_{x}" for x in families),
        "experiment_linear", "experiment_forest", "experiment_boosted",
    }


def test_no_fixed_input(spark, folder):
    from __spark_entry__ import entry

    assert entry(spark).count() > 1000
