"""One sparse feature vector per case, for columns with any number of values.

``CaseEncoder`` makes a column per value and so bounds their number. Here the
values a log has are a table of slots in the shared folder, and a case stores
only the slots it fills: its size follows its own values, not those of the log.

Slots, in this order: mean, max, min, sum and sample deviation of each numeric
column (nulls and no numbers as 0); the count of each value of each dynamic
column, with null as a value; a flag for the static columns' value at the first
event. Values the slots do not know fill none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueline.operators.encoding import category_pairs
from dueline.operators.ranges import cut_into_ranges, with_position
from dueline.session import scratch_path
from dueline.spec import EventLogSpec, col, last_value

#: Column with the vector.
FEATURES = "features"
KINDS = ("mean", "max", "min", "sum", "std")
#: Storage form of an ML vector; type 0 is the sparse one.
_STORED = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
_FILLED = "array<struct<slot:int,x:double>>"
# Up to this many slots go to every task; beyond it they are joined as Spark chooses.
_BROADCAST_SLOTS = 500_000


@dataclass(frozen=True)
class Slots:
    """``table``: role, column, value, slot. ``size``: length of the vectors."""

    table: DataFrame
    size: int


def learn_slots(df: DataFrame, spec: EventLogSpec) -> Slots:
    """The slots of a training log, written once to the shared folder.

    Only their number comes to the driver.
    """
    spark = df.sparkSession
    schema = "role int, place int, column string, value string"
    numeric = [(0, i * len(KINDS) + k, c, kind) for i, c in enumerate(spec.numeric) for k, kind in enumerate(KINDS)]
    slots = spark.createDataFrame(numeric, schema)
    columns = list(dict.fromkeys([*spec.dynamic, *spec.static]))
    if columns:
        # One pass finds the values of all columns; a column of both roles has its values in each.
        held = [(1, i, c) for i, c in enumerate(spec.dynamic)] + [(2, i, c) for i, c in enumerate(spec.static)]
        roles = F.broadcast(spark.createDataFrame(held, "role int, place int, column string"))
        found = category_pairs(df, columns).distinct().join(roles, "column")
        slots = slots.unionByName(found.select("role", "place", "column", "value"))
    keys = [F.col(c) for c in ("role", "place", "value")]
    path = scratch_path(spark, "slots")
    with_position(cut_into_ranges(slots, keys), keys, "slot").select(
        "role", "column", "value", F.col("slot").cast("int").alias("slot")
    ).write.parquet(path)
    table = spark.read.parquet(path)
    return Slots(table, table.count())


def _numeric(spec: EventLogSpec) -> list:
    out = []
    for c in spec.numeric:
        v = F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        out += [F.avg(v), F.max(v), F.min(v), F.sum(v), F.coalesce(F.stddev_samp(v), F.lit(0.0))]
    return out


def _of_role(slots: Slots, role: int, columns: tuple[str, ...]) -> DataFrame:
    """Place of the column, value and slot of a role's slots."""
    places = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    found = slots.table.filter(F.col("role") == role).select(
        places[F.col("column")].alias("_place"), F.col("value").alias("_known"), "slot"
    )
    return _small_side(found, slots)


def _small_side(table: DataFrame, slots: Slots) -> DataFrame:
    return F.broadcast(table) if slots.size <= _BROADCAST_SLOTS else table


def encode_sparse(df: DataFrame, spec: EventLogSpec, slots: Slots, label: str | None = "y") -> DataFrame:
    """(case, label, features): one row per case, written once and read as vectors."""
    out = stored_vectors(df, spec, slots, label)
    path = scratch_path(df.sparkSession, "vectors")
    out.write.parquet(path)
    fields = [f for f in out.schema.fields if f.name != FEATURES]
    schema = T.StructType([*fields, T.StructField(FEATURES, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def stored_vectors(df: DataFrame, spec: EventLogSpec, slots: Slots, label: str | None = "y") -> DataFrame:
    """(case, label, features) with vectors in their storage form.

    Case values are counted before anything is joined, so the slot table meets
    one row per case and value. Rows of a log that already lies by case are counted and
    gathered where they are: values are unrolled, not unpivoted, and slots broadcast, which
    both keep that. Rows without a case id are left out.
    """
    df = df.filter(col(spec.case).isNotNull())
    case = col(spec.case).alias("_case")
    firsts = [F.min_by(F.struct(col(c).cast("string").alias("v")), spec.order_key)["v"] for c in spec.static]
    aggs = [n.alias(f"_n{i}") for i, n in enumerate(_numeric(spec))]
    aggs += [f.alias(f"_s{i}") for i, f in enumerate(firsts)]
    aggs.append((last_value(spec, label) if label else F.lit(None)).alias("_label"))
    rows = df.groupBy(case).agg(*aggs)

    # Slots in their order: numbers, whose place is their slot, values of the case, first values.
    parts = []
    known = [F.struct(F.lit(i).alias("slot"), F.col(f"_n{i}").alias("x")) for i in range(len(spec.numeric) * len(KINDS))]
    if known:
        parts.append(F.filter(F.array(*known), lambda s: s["x"] != 0).cast(_FILLED))
    if spec.dynamic:
        values = [
            F.struct(F.lit(i).alias("p"), col(c).cast("string").alias("v")) for i, c in enumerate(spec.dynamic)
        ]
        counted = (
            df.select(case, F.explode(F.array(*values)).alias("_at"))
            .groupBy("_case", F.col("_at.p").alias("p"), F.col("_at.v").alias("v"))
            .agg(F.count("*").cast("double").alias("x"))
        )
        same = (F.col("p") == F.col("_place")) & F.col("v").eqNullSafe(F.col("_known"))
        # One sort gathers a case and serves the join; an aggregate of lists would sort twice more.
        inside = Window.partitionBy("_case").orderBy("slot")
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = (
            counted.join(_of_role(slots, 1, spec.dynamic), same)
            .select(
                "_case",
                F.collect_list(F.struct("slot", "x")).over(whole).alias("_counts"),
                F.row_number().over(inside).alias("_nr"),
            )
            .filter(F.col("_nr") == 1)
            .drop("_nr")
        )
        rows = rows.join(held, "_case", "left")
        parts.append(F.coalesce(F.col("_counts").cast(_FILLED), F.array().cast(_FILLED)))
    if spec.static:
        table = _of_role(slots, 2, spec.static)
        for i in range(len(spec.static)):
            flags = table.filter(F.col("_place") == i).select("_known", F.col("slot").alias(f"_f{i}"))
            rows = rows.join(flags, F.col(f"_s{i}").eqNullSafe(F.col("_known")), "left").drop("_known")
        flagged = [
            F.when(F.col(f"_f{i}").isNotNull(), F.struct(F.col(f"_f{i}").alias("slot"), F.lit(1.0).alias("x")))
            for i in range(len(spec.static))
        ]
        parts.append(F.array_compact(F.array(*flagged)).cast(_FILLED))
    both = F.concat(*parts) if parts else F.array().cast(_FILLED)
    return rows.select(F.col("_case"), "_label", both.alias("_at")).select(
        F.col("_case").alias(spec.case),
        *([F.col("_label").alias(label)] if label else []),
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(slots.size).alias("size"),
            F.col("_at.slot").alias("indices"),
            F.col("_at.x").alias("values"),
        ).cast(_STORED).alias(FEATURES),
    )


def filled_slots(rows: DataFrame, spec: EventLogSpec, slots: Slots) -> DataFrame:
    """The vectors in long form: case, role, column, value, x."""
    stored = rows.select(col(spec.case), F.unwrap_udt(FEATURES).alias("v"))
    at = F.explode(F.arrays_zip("v.indices", "v.values")).alias("at")
    long = stored.select(col(spec.case), at).select(
        col(spec.case), F.col("at.indices").alias("slot"), F.col("at.values").alias("x")
    )
    return long.join(_small_side(slots.table, slots), "slot").select(col(spec.case), "role", "column", "value", "x")
