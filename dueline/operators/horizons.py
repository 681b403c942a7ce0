"""Feature rows of all prediction horizons from one pass over the log.

Cutting a log at each horizon and encoding it anew reads it once per horizon. Here
each event is put to the number of horizons that still include it (its reach), and
the log is aggregated once, by case and reach, into parts that merge: count, mean and
squared deviations, smallest and largest number, counts per value, first code and
last label. A horizon's row merges the parts of the reaches beyond it, which is a
running merge over at most as many rows per case as there are horizons.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.functions import calendar
from dueline.operators.cutting import horizons_reached
from dueline.operators.encoding import (
    _DIRECT_COLUMNS,
    CaseEncoder,
    CaseEncoderModel,
    category_pairs,
)
from dueline.spec import EventLogSpec, col

HORIZON = "horizon"
_REACH = "_reach"
#: First and last but one place of the horizons (in turn) that a merged row stands for.
FROM, TO = "_from", "_to"


def in_turn(horizons: Iterable[int]) -> list[int]:
    """The horizons, each once, from the deadline back."""
    return sorted(set(horizons))


def with_reach(df: DataFrame, spec: EventLogSpec, horizons: list[int]) -> DataFrame:
    """Events that some horizon includes, with the number of horizons that do.

    An event belongs to the horizons up to some point, so their number says which.
    """
    if horizons == list(range(len(horizons))):
        reach = horizons_reached(spec, len(horizons))
    else:
        left = calendar.workday_steps(col(spec.timestamp), col(spec.deadline))
        reach = F.size(F.filter(F.lit(horizons), lambda h: h <= F.coalesce(left, F.lit(-1))))
    return df.withColumn(_REACH, reach).filter(col(_REACH) > 0)


def fit_horizons(
    df: DataFrame, spec: EventLogSpec, horizons: Iterable[int], **more
) -> dict[int, CaseEncoderModel]:
    """The encoder of each horizon, equal to one fitted on the log cut there.

    One aggregate tells how far each value reaches; a horizon knows those beyond it.
    ``more`` are parameters of ``CaseEncoder``, whose bound on values holds here too.
    """
    encoder = CaseEncoder.for_spec(spec, **more)
    columns = list(dict.fromkeys([*spec.dynamic, *spec.static]))
    horizons = in_turn(horizons)
    rows = []
    if columns:
        most = encoder.get(encoder.maxValues)
        pairs = category_pairs(with_reach(df, spec, horizons), columns, _REACH)
        rows = pairs.groupBy("column", "value").agg(F.max(_REACH)).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} values; use dynamic_counts or raise maxValues")
    return {
        h: encoder.knowing(
            {c: [v for n, v, far in rows if n == c and far > i] for c in columns}, df.schema
        )
        for i, h in enumerate(horizons)
    }


def _numeric(name: str) -> Column:
    return F.coalesce(F.nanvl(col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def _deviation(i: int, name: str) -> Column:
    """Sample deviation from squares within the parts and between their means.

    The latter are taken from the mean of the merged parts, of which there are at most as
    many as horizons, lest squares of large numbers swallow small differences.
    """
    between = F.aggregate(
        "_means",
        F.lit(0.0),
        lambda total, m: total + m["_n"] * F.pow(m[f"_avg{i}"] - col(f"{name}_mean"), F.lit(2.0)),
    )
    spread = F.sqrt((col(f"_inner{i}") + between) / (col("_all") - 1))
    return F.when(col("_all") > 1, spread).otherwise(0.0)


def horizon_rows(
    df: DataFrame, spec: EventLogSpec, models: dict[int, CaseEncoderModel], merged: bool = False
) -> DataFrame:
    """One row per horizon of ``models`` and case with an event left there.

    Columns are the case, ``horizon``, the numeric and dynamic columns of the first
    horizon's model (which knows the values of all others), the static columns as
    its codes, and its label column, if it has one. ``at_horizon`` makes the rows of
    one horizon's own encoder of them. With ``merged`` a row stands once for all
    horizons at which it is the same, see ``_merged_rows``.
    """
    rows = _merged_rows(df, spec, models)
    if merged:
        return rows
    places = F.sequence(col(FROM), col(TO) - 1)
    rows = rows.withColumn(HORIZON, _horizon(places, in_turn(models)))
    names = [c for c in rows.columns if c not in (spec.case, HORIZON, FROM, TO)]
    return rows.select(col(spec.case), HORIZON, *[col(c) for c in names])


def _merged_rows(
    df: DataFrame, spec: EventLogSpec, models: dict[int, CaseEncoderModel]
) -> DataFrame:
    """The rows of ``horizon_rows``, each once for all horizons at which it is the same.

    A case's row only changes where a nearer horizon lets more events in, so there are
    no more rows than pairs of case and reach. Instead of ``horizon`` it has the places
    ``_from`` up to, without, ``_to`` of its horizons in turn.
    """
    horizons = in_turn(models)
    model = models[horizons[0]]
    case, label = col(spec.case), model.get(model.labelCol)
    key = spec.order_key
    slots = list(zip(model._dynamic_slots(), model.dynamic_columns, strict=True))
    direct = len(slots) <= _DIRECT_COLUMNS
    reached = with_reach(df, spec, horizons)
    coded = model.with_codes(reached)

    parts = [F.count("*").alias("_n"), F.min(key).alias("_first")]
    for i, c in enumerate(spec.numeric):
        v = _numeric(c)
        parts += [
            F.sum(v).alias(f"_sum{i}"), F.avg(v).alias(f"_avg{i}"), F.var_pop(v).alias(f"_var{i}"),
            F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"),
        ]
    if direct:
        parts += [
            F.count(F.when(col(c).cast("string").eqNullSafe(F.lit(v)), 1)).alias(f"_slot{i}")
            for i, ((c, v), _) in enumerate(slots)
        ]
    parts += [F.min_by(col(f"_code{i}"), key).alias(f"_code{i}") for i in range(len(spec.static))]
    if label:
        known = F.when(col(label).isNotNull(), key)
        parts += [F.max(known).alias("_last"), F.max_by(col(label), known).alias("_label")]
    parted = coded.groupBy(case.alias("_case"), _REACH).agg(*parts)

    # At most one row per horizon and case from here on.
    by_reach = Window.partitionBy("_case").orderBy(F.desc(_REACH))
    beyond = by_reach.rowsBetween(Window.unboundedPreceding, 0)
    # The next shorter reach is the nearest horizon at which more events come in.
    nearest = F.coalesce(F.lead(_REACH).over(by_reach), F.lit(0)).alias("_nearest")
    merged = [col("_case"), col(_REACH), nearest]
    if spec.numeric:
        means = F.struct("_n", *[f"_avg{i}" for i in range(len(spec.numeric))])
        merged += [F.collect_list(means).over(beyond).alias("_means"), F.sum("_n").over(beyond).alias("_all")]
    for i, c in enumerate(spec.numeric):
        merged += [
            F.max(f"_max{i}").over(beyond).alias(f"{c}_max"),
            F.min(f"_min{i}").over(beyond).alias(f"{c}_min"),
            F.sum(f"_sum{i}").over(beyond).alias(f"{c}_sum"),
            F.sum(col("_n") * col(f"_var{i}")).over(beyond).alias(f"_inner{i}"),
        ]
    if direct:
        merged += [F.sum(f"_slot{i}").over(beyond).alias(name) for i, (_, name) in enumerate(slots)]
    merged += [
        F.min_by(f"_code{i}", "_first").over(beyond).alias(c) for i, c in enumerate(spec.static)
    ]
    if label:
        merged.append(F.max_by("_label", "_last").over(beyond).alias(label))
    rows = parted.select(*merged)
    rows = rows.withColumns({f"{c}_mean": col(f"{c}_sum") / col("_all") for c in spec.numeric})
    rows = rows.withColumns({f"{c}_std": _deviation(i, c) for i, c in enumerate(spec.numeric)})
    if not direct:
        wide = _wide_counts(reached, spec, slots, horizons)
        # The farthest of the row's horizons; the counts are those of all of them.
        farthest = F.get(F.lit(horizons), col(_REACH) - 1)
        same = [col("_case").eqNullSafe(col("_wide_case")), farthest == col("_wide_horizon")]
        rows = rows.join(wide, same).drop("_wide_case", "_wide_horizon")
    names = [*model.numeric_columns, *model.dynamic_columns, *spec.static]
    return rows.select(
        col("_case").alias(spec.case), *[col(x) for x in names], *([col(label)] if label else []),
        col("_nearest").alias(FROM), col(_REACH).alias(TO),
    )


def _horizon(places: Column, horizons: list[int]) -> Column:
    """One row per place, holding its horizon."""
    return F.explode(F.transform(places, lambda i: F.get(F.lit(horizons), i)))


def _wide_counts(
    reached: DataFrame, spec: EventLogSpec, slots: list, horizons: list[int]
) -> DataFrame:
    """Counts per horizon, case and slot, pivoted, for long value lists."""
    table = [(c, v, i) for i, ((c, v), _) in enumerate(slots)]
    # The fitted list, bounded by maxValues.
    slot = reached.sparkSession.createDataFrame(table, "_c string, _v string, _slot int")
    counts = (
        category_pairs(reached, list(spec.dynamic), spec.case, _REACH)
        .groupBy(col(spec.case).alias("_wide_case"), _REACH, "column", "value")
        .agg(F.count("*").alias("n"))
    )
    same = (F.col("column") == F.col("_c")) & F.col("value").eqNullSafe(F.col("_v"))
    wide = (
        counts.join(F.broadcast(slot), same, "left")
        .withColumn("_wide_horizon", _horizon(F.sequence(F.lit(0), col(_REACH) - 1), horizons))
        .groupBy("_wide_case", "_wide_horizon")
        .pivot("_slot", list(range(len(slots))))
        .agg(F.sum("n"))
    )
    named = [F.coalesce(col(str(i)), F.lit(0)).alias(name) for i, (_, name) in enumerate(slots)]
    return wide.select("_wide_case", "_wide_horizon", *named)


def at_horizon(
    rows: DataFrame, spec: EventLogSpec, horizon: int, models: dict[int, CaseEncoderModel]
) -> DataFrame:
    """The rows of one horizon, as its own encoder would give them.

    ``rows`` are those of ``horizon_rows``, merged or not. Columns of values that its training cases have not yet shown go, and static codes
    become positions in its shorter lists.
    """
    model, widest = models[horizon], models[min(models)]
    out = [col(spec.case), *[col(c) for c in (*model.numeric_columns, *model.dynamic_columns)]]
    one_hot = model.get(model.oneHotStatic)
    for c in spec.static:
        own = {v: k for k, v in enumerate(model.values[c])}
        # Position 0 is for the code -1; a null code stays null.
        codes = F.array(F.lit(-1), *[F.lit(own.get(v, -1)) for v in widest.values[c]])
        code = F.element_at(codes, col(c) + 2)
        if not one_hot:
            out.append(code.alias(c))
            continue
        out += [F.when(code == k, 1).otherwise(0).alias(f"{c}_{k}") for k in model._codes(c)]
        out.append(F.lit(0).alias(f"{c}_nan"))
    label = model.get(model.labelCol)
    place = in_turn(models).index(horizon)
    here = (col(FROM) <= place) & (col(TO) > place) if TO in rows.columns else col(HORIZON) == horizon
    return rows.filter(here).select(*out, *([col(label)] if label else []))
