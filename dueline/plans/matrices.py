"""Train and test rows of all horizons, written once per content of their inputs."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.caselog import CaseLog
from dueline.operators import horizons as sweep
from dueline.operators.encoding import CaseEncoder, CaseEncoderModel
from dueline.sources.cache import content_key, kept_under, read_text, write_text
from dueline.spec import EventLogSpec, col

SIDE = "_side"


@dataclass
class HorizonMatrices:
    """Rows in a folder by side and horizon, and the encoder of each horizon."""

    spark: SparkSession
    path: str
    spec: EventLogSpec
    models: dict[int, CaseEncoderModel]
    built: bool

    def rows(self, side: str, horizon: int) -> DataFrame:
        """The rows of ``train`` or ``test``, of which only folders that reach the horizon are read."""
        table = self.spark.read.parquet(f"{self.path}/table").filter(col(SIDE) == side)
        return sweep.at_horizon(table, self.spec, horizon, self.models)


def horizon_matrices(
    log: CaseLog,
    horizons: Iterable[int],
    train_ids: DataFrame,
    test_ids: DataFrame,
    folder: str,
    one_hot_static: bool = True,
    label: str = "y",
) -> HorizonMatrices:
    """Train and test rows of the horizons in ``folder``, read back if they are there.

    Encoders learn from the training cases left at their horizon. A row that is the same at
    several horizons is kept once, so what is written grows with the events, not with the
    horizons. The log is read twice,
    for the values and for the rows of all horizons; a second call with unchanged input
    files, plan and settings does not read it.
    """
    spark, spec = log.df.sparkSession, log.spec
    settings = {
        "spec": repr(spec), "horizons": sweep.in_turn(horizons), "one_hot": one_hot_static, "label": label,
        "rows": "merged",
    }
    key = content_key([log.df, train_ids, test_ids], settings)

    def build(path: str) -> None:
        train = log.keep_cases(train_ids).df
        models = sweep.fit_horizons(train, spec, horizons, oneHotStatic=one_hot_static, labelCol=label)
        told = [[h, m.getOrDefault(m.learned)] for h, m in models.items()]
        write_text(spark, f"{path}/encoders.json", json.dumps(told))
        rows = sweep.horizon_rows(log.df, spec, models, True)
        sides = (
            train_ids.select(col(spec.case)).distinct().withColumn(SIDE, F.lit("train"))
            .unionByName(test_ids.select(col(spec.case)).distinct().withColumn(SIDE, F.lit("test")))
        )
        both = rows.join(sides, spec.case).select(*[col(c) for c in rows.columns], SIDE)
        both = both.withColumn(label, col(label).cast("int"))
        both.write.mode("overwrite").partitionBy(SIDE, sweep.TO).parquet(f"{path}/table")

    path, built = kept_under(spark, folder, key, build)
    encoder = CaseEncoder.for_spec(spec, oneHotStatic=one_hot_static, labelCol=label)
    models = {
        h: encoder._copyValues(CaseEncoderModel())._set(learned=learned)
        for h, learned in json.loads(read_text(spark, f"{path}/encoders.json"))
    }
    return HorizonMatrices(spark, path, spec, models, built)
