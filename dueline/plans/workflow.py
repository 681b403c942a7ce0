"""From an event log to labelled log and to train and test rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.operators import features, filters
from dueline.operators.cutting import cut_before_deadline
from dueline.operators.encoding import CaseEncoder, CaseEncoderModel
from dueline.operators.labeling import (
    ABORT_PAYMENT,
    BEGIN_PAYMENT,
    PAYMENT_DEADLINES,
    deadline_by_year,
    late_payment_label,
)
from dueline.session import scratch_path
from dueline.spec import EventLogSpec, col


def labelled_log(
    df: DataFrame,
    spec: EventLogSpec,
    keep: tuple[str, str] = ("doctype", "Payment application"),
    case_year: str = "case:year",
    begin: str = BEGIN_PAYMENT,
    abort: str = ABORT_PAYMENT,
    deadlines: dict[int, str] = PAYMENT_DEADLINES,
) -> CaseLog:
    """Events of one document type, with features, label and deadline.

    A case is one application in one year; only its events in that year stay.
    All windows share one exchange and one sort by case.
    """
    ts = col(spec.timestamp)
    df = df.filter(col(keep[0]) == keep[1])
    df = df.withColumn(case_year, col(case_year).cast("int"))
    df = df.filter(F.year(ts) == col(case_year))
    df = filters.composite_case_key(df, spec, case_year)
    log = CaseLog.of(df, spec)
    for step in (
        features.time_attributes,
        features.time_since_last_event,
        features.time_since_first_event,
        features.event_number,
        features.event_duration,
        features.remaining_time,
        features.total_duration,
    ):
        log = step(log)
    log = late_payment_label(log, begin, abort)
    log = features.trace_length(log)
    return deadline_by_year(log, deadlines, spec.deadline)


@dataclass
class TrainTest:
    """Encoded cases of both sides and the encoder they share."""

    train: DataFrame
    test: DataFrame
    encoder: CaseEncoderModel


def train_test_rows(
    log: CaseLog,
    business_days: int,
    train_ids: DataFrame,
    test_ids: DataFrame,
    one_hot_static: bool = True,
    label: str = "y",
) -> TrainTest:
    """Feature rows of the prefixes left so many business days before deadline.

    The encoder learns its columns from the training cases only. All cases are
    encoded once, joined with their side and written by side; both sides are
    read from there.
    """
    cut = cut_before_deadline(log, business_days)
    encoder = CaseEncoder.for_spec(log.spec, oneHotStatic=one_hot_static, labelCol=label)
    model = encoder.fit(cut.keep_cases(train_ids).df)
    rows = model.transform(cut.df).withColumn(label, col(label).cast("int"))
    case = log.spec.case
    side = "_side"
    sides = (
        train_ids.select(col(case)).distinct().withColumn(side, F.lit("train"))
        .unionByName(test_ids.select(col(case)).distinct().withColumn(side, F.lit("test")))
    )
    spark = rows.sparkSession
    path = scratch_path(spark, "sides")
    both = rows.join(sides, case).select(*[col(c) for c in rows.columns], side)
    both.write.partitionBy(side).parquet(path)
    saved = spark.read.schema(both.schema).parquet(path)
    return TrainTest(
        saved.filter(col(side) == "train").drop(side),
        saved.filter(col(side) == "test").drop(side),
        model,
    )
