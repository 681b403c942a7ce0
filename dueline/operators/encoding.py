"""One feature row per case, as a Spark ML estimator.

``CaseEncoder.fit`` learns which values the categorical columns take on the
training log; the model turns any log prefix into rows with these columns:

* numeric: mean, max, min, sum and sample deviation, nulls taken as 0;
* dynamic: how often each value occurs in the case, and how often none;
* static: code of the first event's value (sorted values from 0, null and
  unknown -1), or one column per code.

All of it is one ``groupBy`` with map-side combine, so a case of any size costs
a few partial rows. A long value list switches to counting (case, value) pairs
first, which keeps the work per event constant.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueline.spec import EventLogSpec, col, last_value

# More dynamic columns than this are counted as pairs and pivoted.
_DIRECT_COLUMNS = 200
# More values than this are coded by a join instead of a literal list.
_LISTED_CODES = 200


def _as_text(name: str) -> Column:
    return col(name).cast("string")


def category_pairs(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Each event's categorical values as rows (column, value), next to ``keep``."""
    texts = df.select(*[col(k) for k in keep], *[_as_text(c).alias(c) for c in columns])
    return texts.unpivot(
        [col(k) for k in keep], [col(c) for c in columns], "column", "value"
    )


def dynamic_counts(df: DataFrame, spec: EventLogSpec) -> DataFrame:
    """Counts per case, column and value, in long form.

    Has no column per value, so it serves columns with any number of values.
    """
    pairs = category_pairs(df, list(spec.dynamic), spec.case)
    return pairs.groupBy(col(spec.case), "column", "value").agg(F.count("*").alias("n"))


def _sorted_values(values: list[str], kind: T.DataType) -> list[str]:
    """Sort by the value, not by its text."""
    if isinstance(kind, T.NumericType):
        return sorted(values, key=float)
    return sorted(values)


class _Settings(Params):
    caseCol = Param(Params._dummy(), "caseCol", "case id", TypeConverters.toString)
    orderBy = Param(Params._dummy(), "orderBy", "order of events", TypeConverters.toListString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric", TypeConverters.toListString)
    dynamicCols = Param(Params._dummy(), "dynamicCols", "dynamic", TypeConverters.toListString)
    staticCols = Param(Params._dummy(), "staticCols", "static", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label or empty", TypeConverters.toString)
    oneHotStatic = Param(Params._dummy(), "oneHotStatic", "one-hot", TypeConverters.toBoolean)
    maxValues = Param(Params._dummy(), "maxValues", "most values kept", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            caseCol="case:concept:name",
            orderBy=["time:timestamp"],
            numericCols=[],
            dynamicCols=[],
            staticCols=[],
            labelCol="y",
            oneHotStatic=False,
            maxValues=20_000,
        )

    def get(self, param: Param):
        return self.getOrDefault(param)


class CaseEncoder(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self,
        *,
        caseCol=None,
        orderBy=None,
        numericCols=None,
        dynamicCols=None,
        staticCols=None,
        labelCol=None,
        oneHotStatic=None,
        maxValues=None,
    ):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    @classmethod
    def for_spec(cls, spec: EventLogSpec, **more) -> CaseEncoder:
        return cls(
            caseCol=spec.case,
            orderBy=list(spec.order_by),
            numericCols=list(spec.numeric),
            dynamicCols=list(spec.dynamic),
            staticCols=list(spec.static),
            **more,
        )

    def _fit(self, df: DataFrame) -> CaseEncoderModel:
        """One distinct over (column, value); the lists come to the driver.

        The result is a schema, so more than ``maxValues`` is an error rather
        than a cut-off; ``dynamic_counts`` is the form without that bound.
        """
        dynamic, static = self.get(self.dynamicCols), self.get(self.staticCols)
        columns = list(dict.fromkeys([*dynamic, *static]))
        values: dict[str, list[str | None]] = {c: [] for c in columns}
        if columns:
            most = self.get(self.maxValues)
            pairs = category_pairs(df, columns).distinct()
            rows = pairs.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} values; use dynamic_counts or raise maxValues")
            for name, value in rows:
                values[name].append(value)
        return self.knowing(values, df.schema)

    def knowing(self, values: dict[str, list[str | None]], schema: T.StructType) -> CaseEncoderModel:
        """The model of columns that take these values, None where one has nulls."""
        kept = {c: [v for v in known if v is not None] for c, known in values.items()}
        learned = {
            "values": {c: _sorted_values(known, schema[c].dataType) for c, known in kept.items()},
            "nulls": [c for c, known in values.items() if None in known],
        }
        model = CaseEncoderModel()
        self._copyValues(model)
        model._set(learned=json.dumps(learned))
        twice = [c for c, n in Counter(model.columns).items() if n > 1]
        if twice:
            raise ValueError(f"columns encoded twice: {twice}")
        return model


class CaseEncoderModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    learned = Param(Params._dummy(), "learned", "value lists as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._defaults()

    # -- what the columns are ---------------------------------------------

    @property
    def values(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.learned))["values"]

    @property
    def _with_nulls(self) -> list[str]:
        return json.loads(self.getOrDefault(self.learned))["nulls"]

    @property
    def numeric_columns(self) -> list[str]:
        kinds = ["mean", "max", "min", "sum", "std"]
        return [f"{c}_{k}" for c in self.get(self.numericCols) for k in kinds]

    def _dynamic_slots(self) -> list[tuple[str, str | None]]:
        values = self.values
        return [(c, v) for c in self.get(self.dynamicCols) for v in [*values[c], None]]

    @property
    def dynamic_columns(self) -> list[str]:
        return [f"{c}_{'nan' if v is None else v}" for c, v in self._dynamic_slots()]

    def _codes(self, name: str) -> list[int]:
        known = list(range(len(self.values[name])))
        return [-1, *known] if name in self._with_nulls else known

    @property
    def static_columns(self) -> list[str]:
        static = self.get(self.staticCols)
        if not self.get(self.oneHotStatic):
            return static
        return [f"{c}_{k}" for c in static for k in [*self._codes(c), "nan"]]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric_columns, *self.dynamic_columns, *self.static_columns]

    @property
    def static_positions(self) -> list[int]:
        start = len(self.numeric_columns) + len(self.dynamic_columns)
        return list(range(start, start + len(self.static_columns)))

    # -- encoding ----------------------------------------------------------

    def _spec(self) -> EventLogSpec:
        return EventLogSpec(
            case=self.get(self.caseCol),
            timestamp=None,
            order_by=tuple(self.get(self.orderBy)),
            dynamic=tuple(self.get(self.dynamicCols)),
        )

    def with_codes(self, df: DataFrame) -> DataFrame:
        """Add ``_code<i>`` for each static column, per event."""
        for i, name in enumerate(self.get(self.staticCols)):
            values = self.values[name]
            if len(values) <= _LISTED_CODES:
                listed = F.array(*[F.lit(v) for v in values]).cast("array<string>")
                code = F.coalesce(F.array_position(listed, _as_text(name)) - 1, F.lit(-1))
                df = df.withColumn(f"_code{i}", code.cast("int"))
                continue
            # As long as the fitted list, which maxValues bounds.
            table = df.sparkSession.createDataFrame(
                [(v, k) for k, v in enumerate(values)], f"_value{i} string, _code{i} int"
            )
            df = df.join(F.broadcast(table), _as_text(name) == col(f"_value{i}"), "left")
            df = df.drop(f"_value{i}").fillna(-1, [f"_code{i}"])
        return df

    def _numeric(self) -> list[Column]:
        out = []
        for c in self.get(self.numericCols):
            v = F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
            spread = F.coalesce(F.stddev_samp(v), F.lit(0.0))
            for kind, agg in zip(
                ["mean", "max", "min", "sum", "std"],
                [F.avg(v), F.max(v), F.min(v), F.sum(v), spread],
                strict=True,
            ):
                out.append(agg.alias(f"{c}_{kind}"))
        return out

    def _counts(self) -> list[Column]:
        return [
            F.count(F.when(_as_text(c).eqNullSafe(F.lit(v)), 1)).alias(name)
            for (c, v), name in zip(self._dynamic_slots(), self.dynamic_columns, strict=True)
        ]

    def _pivoted_counts(self, df: DataFrame) -> DataFrame:
        slots = self._dynamic_slots()
        rows = [(c, v, i) for i, (c, v) in enumerate(slots)]
        # The fitted list again, bounded by maxValues.
        slot = df.sparkSession.createDataFrame(rows, "_c string, _v string, _slot int")
        counts = dynamic_counts(df, self._spec())
        same = (F.col("column") == F.col("_c")) & F.col("value").eqNullSafe(F.col("_v"))
        case = col(self.get(self.caseCol))
        wide = (
            counts.join(F.broadcast(slot), same, "left")
            .groupBy(case)
            .pivot("_slot", list(range(len(slots))))
            .agg(F.sum("n"))
        )
        named = [
            F.coalesce(col(str(i)), F.lit(0)).alias(n) for i, n in enumerate(self.dynamic_columns)
        ]
        return wide.select(case, *named)

    def _transform(self, df: DataFrame) -> DataFrame:
        case, spec = col(self.get(self.caseCol)), self._spec()
        static, label = self.get(self.staticCols), self.get(self.labelCol)
        direct = len(self._dynamic_slots()) <= _DIRECT_COLUMNS
        aggs = self._numeric()
        if direct:
            aggs += self._counts()
        coded = self.with_codes(df)
        aggs += [
            F.min_by(col(f"_code{i}"), spec.order_key).alias(f"_code{i}")
            for i in range(len(static))
        ]
        if label:
            aggs.append(last_value(spec, label).alias(label))
        if not aggs:
            aggs.append(F.count("*").alias("_events"))
        rows = coded.groupBy(case).agg(*aggs)
        if not direct:
            # Null-safe, as rows without a case id are a case as well.
            name = self.get(self.caseCol)
            wide = self._pivoted_counts(df).withColumnRenamed(name, "_wide_case")
            rows = rows.join(wide, case.eqNullSafe(col("_wide_case"))).drop("_wide_case")
        out = [col(n) for n in [*self.numeric_columns, *self.dynamic_columns]]
        for i, c in enumerate(static):
            if not self.get(self.oneHotStatic):
                out.append(col(f"_code{i}").alias(c))
                continue
            for k in self._codes(c):
                out.append(F.when(col(f"_code{i}") == k, 1).otherwise(0).alias(f"{c}_{k}"))
            out.append(F.lit(0).alias(f"{c}_nan"))
        return rows.select(case, *out, *([col(label)] if label else []))


def feature_cardinality(encoded: DataFrame, static: list[str]) -> DataFrame:
    """Distinct codes per static column and the embedding size they suggest."""
    pairs = [F.struct(F.lit(c).alias("feature"), col(c).alias("code")) for c in static]
    rows = encoded.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    n = F.countDistinct("code")
    return rows.groupBy("feature").agg(
        n.alias("n_values"), (F.floor(n / 2) + 1).alias("embedding_size")
    )
