"""An event log that stays spread out when one case is huge.

Most cases fit a task, and window functions over the case are the best plan
for them: one exchange and one sort serve every feature. A case with a large
part of all events does not fit. ``CaseLog`` keeps the two apart:

* ``short``: all cases up to ``spec.long_case_events`` events, by window;
* ``long``: the others, cut into ranges of ``(case, order_by)``. Values of a
  whole case are aggregated with map-side combine and broadcast back (one row
  per long case); order-dependent values are taken inside a range and mended
  at its edges from a table with one row per case and range.

Both halves go through the same calls, and ``df`` is their union, with the same
columns in the same order. Without long cases, the usual state, there is only the
plain window plan. A log that only goes through row-wise steps is never parted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.operators.ranges import RANGE, chunks_for, cut_into_ranges
from dueline.spec import EventLogSpec, col, first_value, last_value

# Up to this many long case ids travel through the driver as literals of a
# local table; beyond it they are kept as a checkpointed table.
_LISTED_IDS = 10_000
# Up to this many rows a per-case table for the long half is broadcast.
_BROADCAST_ROWS = 1_000_000


class CaseLog:
    def __init__(
        self,
        spec: EventLogSpec,
        short: DataFrame,
        long: DataFrame | None = None,
        ids: DataFrame | None = None,
        small_ids: bool = True,
        whole: bool = False,
    ) -> None:
        self.spec, self._short, self._long = spec, short, long
        self._ids, self._small, self._whole = ids, small_ids, whole

    @classmethod
    def of(cls, df: DataFrame, spec: EventLogSpec) -> CaseLog:
        """Wrap ``df``. Rows without a case id are left out, as a group key.

        No job starts here: the first step that needs the rows of a case
        together counts events per case once.
        """
        lost = spec.missing(df.columns)
        if lost:
            raise ValueError(f"columns missing from the log: {lost}")
        return cls(spec, df.filter(col(spec.case).isNotNull()), whole=True)

    def _divide(self) -> None:
        """Part the cases into short and long ones, if that is not done yet."""
        if not self._whole:
            return
        spec = self.spec
        df, self._whole = self._short, False
        sizes = (
            df.select(col(spec.case))
            .groupBy(col(spec.case))
            .agg(F.count("*").alias("_events"))
            .filter(F.col("_events") > spec.long_case_events)
        )
        listed = sizes.limit(_LISTED_IDS + 1).collect()
        if not listed:
            return
        spark = df.sparkSession
        if len(listed) <= _LISTED_IDS:
            rows = sum(r["_events"] for r in listed)
            many = len(listed)
            ids = spark.createDataFrame([(r[spec.case],) for r in listed], sizes.select(col(spec.case)).schema)
        else:
            saved = cut_into_ranges(sizes, [col(spec.case)]).drop(RANGE)
            many, rows = saved.agg(F.count("*"), F.sum("_events")).first()
            ids = saved.select(col(spec.case))
        self._ids, self._small = ids, many <= _BROADCAST_ROWS
        known = F.broadcast(ids) if self._small else ids
        # A join by name puts the name first; both halves keep the order of ``df``.
        order = [col(c) for c in df.columns]
        self._short = df.join(known, spec.case, "left_anti").select(*order)
        self._long = cut_into_ranges(
            df.join(known, spec.case, "left_semi").select(*order),
            [col(spec.case), *spec.order],
            chunks_for(rows, spec.long_case_events),
        )

    @property
    def short(self) -> DataFrame:
        self._divide()
        return self._short

    @property
    def long(self) -> DataFrame | None:
        self._divide()
        return self._long

    # -- plain access -----------------------------------------------------

    @property
    def df(self) -> DataFrame:
        if self._long is None:
            return self._short
        return self._short.unionByName(self._long.drop(RANGE))

    @property
    def columns(self) -> list[str]:
        return self._short.columns

    def has(self, name: str) -> bool:
        return name in self._short.columns

    def with_spec(self, **changes) -> CaseLog:
        spec = self.spec.but(**changes)
        if spec.case != self.spec.case:
            return CaseLog.of(self.df, spec)
        return CaseLog(spec, self._short, self._long, self._ids, self._small, self._whole)

    def _both(self, short: DataFrame, long: DataFrame | None) -> CaseLog:
        if long is not None:
            long = long.select(*[col(c) for c in short.columns], RANGE)
        return CaseLog(self.spec, short, long, self._ids, self._small, self._whole)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> CaseLog:
        """Apply a row-wise step to both halves."""
        return self._both(fn(self._short), None if self._long is None else fn(self._long))

    def with_columns(self, columns: dict[str, Column]) -> CaseLog:
        return self.map(lambda d: d.withColumns(columns))

    def filter(self, condition: Column) -> CaseLog:
        return self.map(lambda d: d.filter(condition))

    def drop(self, *names: str) -> CaseLog:
        return self.map(lambda d: d.drop(*names))

    def transform(self, fn: Callable[..., CaseLog], *args, **kwargs) -> CaseLog:
        return fn(self, *args, **kwargs)

    # -- values of the whole case ----------------------------------------

    def _small_side(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self._small else table

    def per_case(self, **values: Column) -> CaseLog:
        """Aggregates of the case, repeated on each of its rows."""
        case = col(self.spec.case)
        whole = Window.partitionBy(case)
        short = self.short.withColumns({n: v.over(whole) for n, v in values.items()})
        if self.long is None:
            return self._both(short, None)
        table = self.long.groupBy(case).agg(*[v.alias(n) for n, v in values.items()])
        long = self.long.drop(*values).join(self._small_side(table), self.spec.case)
        return self._both(short, long)

    def first(self, name: str) -> Column:
        """Aggregate for ``per_case``: first non-null value in event order."""
        return first_value(self.spec, name)

    def last(self, name: str) -> Column:
        """Aggregate for ``per_case``: last non-null value in event order."""
        return last_value(self.spec, name)

    # -- values that depend on the order of events ------------------------

    def in_order(
        self,
        number: str | None = None,
        previous: dict[str, str] | None = None,
        following: dict[str, str] | None = None,
    ) -> CaseLog:
        """Event number, and values of the neighbouring events.

        ``previous`` and ``following`` map a new column to the column read.
        """
        previous, following = previous or {}, following or {}
        case, order, key = col(self.spec.case), self.spec.order, self.spec.order_key
        w = Window.partitionBy(case).orderBy(*order)
        new = {n: F.lag(col(c)).over(w) for n, c in previous.items()}
        new |= {n: F.lead(col(c)).over(w) for n, c in following.items()}
        if number:
            new[number] = F.row_number().over(w).cast("long")
        short = self.short.withColumns(new)
        if self.long is None:
            return self._both(short, None)

        edges = self.long.groupBy(case, F.col(RANGE)).agg(
            F.count("*").alias("_n"),
            *[F.max_by(col(c), key).alias(f"_last{i}") for i, c in enumerate(previous.values())],
            *[F.min_by(col(c), key).alias(f"_head{i}") for i, c in enumerate(following.values())],
        )
        ranges = Window.partitionBy(case).orderBy(RANGE)
        so_far = ranges.rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(
            case,
            RANGE,
            F.col("_n"),
            F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"),
            *[F.lag(f"_last{i}").over(ranges).alias(f"_prev{i}") for i in range(len(previous))],
            *[F.lead(f"_head{i}").over(ranges).alias(f"_next{i}") for i in range(len(following))],
        )
        # One row per long case and range, so no larger than the ids.
        long = self.long.drop(*new).join(self._small_side(edges), [self.spec.case, RANGE])
        inside = Window.partitionBy(case, F.col(RANGE)).orderBy(*order)
        long = long.withColumn("_at", F.row_number().over(inside).cast("long"))
        picked = {}
        for i, (n, c) in enumerate(previous.items()):
            lag = F.lag(col(c)).over(inside)
            picked[n] = F.when(F.col("_at") == 1, F.col(f"_prev{i}")).otherwise(lag)
        for i, (n, c) in enumerate(following.items()):
            lead = F.lead(col(c)).over(inside)
            picked[n] = F.when(F.col("_at") == F.col("_n"), F.col(f"_next{i}")).otherwise(lead)
        if number:
            picked[number] = F.col("_before") + F.col("_at")
        long = long.withColumns(picked).select(
            *[col(c) for c in self.long.columns if c not in picked], *[col(n) for n in picked]
        )
        return self._both(short, long)

    def numbered(self, name: str = "event_nr") -> CaseLog:
        """With the event number, which from here on is the order of events.

        Aggregates that pick a first or last value then compare one number
        instead of several columns and stay hash aggregates.
        """
        log = self if self.has(name) else self.in_order(number=name)
        return log.with_spec(order_by=(name,))

    # -- joins with a table of one row per case ---------------------------

    def _for_long(self, table: DataFrame) -> DataFrame:
        kept = table.join(self._small_side(self._ids), self.spec.case, "left_semi")
        return self._small_side(kept)

    def join_cases(self, table: DataFrame, how: str = "left") -> CaseLog:
        """Add case attributes; ``table`` has one row per case.

        For long cases only their own rows of ``table`` are kept, so that side
        is as small as the list of long cases and the events do not move.
        """
        short = self.short.join(table, self.spec.case, how)
        long = self.long
        if long is not None:
            long = long.join(self._for_long(table), self.spec.case, how)
        return self._both(short, long)

    def keep_cases(self, ids: DataFrame) -> CaseLog:
        """Semi join with a table of case ids."""
        ids = ids.select(col(self.spec.case))
        short = self.short.join(ids, self.spec.case, "left_semi")
        long = self.long
        if long is not None:
            long = long.join(self._for_long(ids), self.spec.case, "left_semi")
        return self._both(short, long)
