"""Order over whole tables without a single-task sort.

A window without partition keys runs in one task. Here the rows are cut into
ranges of their sort key instead, each range is ordered by a task of its own,
and what lies before a range comes from a table with one row per range.

The range number depends on sampled bounds, so the cut table is checkpointed
in the shared folder before it is read more than once: every reader then sees
the same cut, and a lost executor costs no more than a reread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.session import shared_folder
from dueline.spec import col

RANGE = "_range"


def cut_into_ranges(df: DataFrame, keys: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with the number of its key range, lineage cut."""
    shared_folder(df.sparkSession)
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(parts, 1), *keys)
    return ranged.withColumn(RANGE, F.spark_partition_id()).checkpoint()


def range_sizes(cut: DataFrame) -> dict[int, int]:
    """Rows per range: one number per range, brought to the driver."""
    return {r[RANGE]: r["count"] for r in cut.groupBy(RANGE).count().collect()}


def with_position(cut: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """0-based position of every row of a cut table; ``keys`` as it was cut."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: neither this window nor the broadcast grows further.
    before = cut.groupBy(RANGE).count().select(
        RANGE, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy(RANGE).orderBy(*keys))
    return (
        cut.join(F.broadcast(before), RANGE)
        .withColumn(name, F.col("_before") + local - 1)
        .drop(RANGE, "_before")
    )


def row_at(cut: DataFrame, sizes: dict[int, int], keys: list[Column], position: int):
    """The row at one 0-based position of a cut table, or None past the end.

    Only the range that holds the position is ordered.
    """
    seen = 0
    for part in sorted(sizes):
        if position < seen + sizes[part]:
            rank = F.row_number().over(Window.partitionBy(RANGE).orderBy(*keys))
            inside = cut.filter(F.col(RANGE) == part).withColumn("_rank", rank)
            return inside.filter(F.col("_rank") == position - seen + 1).first()
        seen += sizes[part]
    return None


def running_totals(
    df: DataFrame,
    group: list[str],
    key: str,
    before: dict[str, str],
    overall: dict[str, str] | None = None,
) -> DataFrame:
    """Totals per group over the rows before this one, in the order of ``key``.

    ``before`` maps a new column to the column it sums, ``overall`` likewise
    for the sum over the whole group; ``(group, key)`` has to be unique. A
    group of any size is spread over as many tasks as it fills.
    """
    overall = overall or {}
    cut = cut_into_ranges(df, [*[col(g) for g in group], col(key)])
    groups = [col(g) for g in group]
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sources = dict.fromkeys([*before.values(), *overall.values()])
    sums = {src: f"_sum{i}" for i, src in enumerate(sources)}
    parts = cut.groupBy(*groups, RANGE).agg(*[F.sum(col(s)).alias(n) for s, n in sums.items()])
    parts = parts.select(
        *[col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(RANGE).alias("_part"),
        *[
            F.coalesce(F.sum(sums[src]).over(earlier), F.lit(0)).alias(f"_to_{new}")
            for new, src in before.items()
        ],
        *[F.sum(sums[src]).over(whole).alias(new) for new, src in overall.items()],
    )
    same = F.col(RANGE) == F.col("_part")
    for i, g in enumerate(group):
        same = same & col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = (
        Window.partitionBy(*groups, RANGE)
        .orderBy(col(key))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per range and group in it grows with the groups: no forced broadcast.
    out = cut.join(parts, same)
    for new, src in before.items():
        local = F.coalesce(F.sum(col(src)).over(inside), F.lit(0))
        out = out.withColumn(new, F.col(f"_to_{new}") + local)
    return out.select(*[col(c) for c in [*df.columns, *before, *overall]])


def group_percentiles(
    df: DataFrame, group: list[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Exact percentiles per group, linear between neighbours.

    The built-in exact percentile keeps every distinct value of a group in one
    task. Here equal values are counted first, positions come from running
    totals, and the last step needs two values per percentile. Meant for few,
    large groups.
    """
    groups = [col(g) for g in group]
    counted = (
        df.filter(col(value).isNotNull())
        .groupBy(*groups, col(value))
        .agg(F.count("*").alias("_n"))
    )
    placed = running_totals(counted, group, value, {"_lo": "_n"}, {"_size": "_n"})

    def value_at(position: Column) -> Column:
        holds = (F.col("_lo") <= position) & (position < F.col("_lo") + F.col("_n"))
        return F.max(F.when(holds, col(value)))

    picks, answers = [], []
    for name, share in shares.items():
        exact = (F.col("_size") - 1) * F.lit(float(share))
        picks += [
            value_at(F.floor(exact)).alias(f"_a_{name}"),
            value_at(F.ceil(exact)).alias(f"_b_{name}"),
            F.max(exact - F.floor(exact)).alias(f"_f_{name}"),
        ]
        a, b, f = F.col(f"_a_{name}"), F.col(f"_b_{name}"), F.col(f"_f_{name}")
        answers.append((a + (b - a) * f).alias(name))
    return placed.groupBy(*groups).agg(*picks).select(*groups, *answers)


def chunks_for(rows: int, size: int) -> int:
    return max(2, math.ceil(rows / max(size, 1)))
