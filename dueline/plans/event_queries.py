"""Queries for sources, filters, event features and the calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from dueline.functions import calendar
from dueline.operators import features, filters
from dueline.operators.labeling import late_payment_label
from dueline.plans.registry import (
    CLICK_LOG, CLICK_W, DAYS, ORDER_LOG, ORDER_W, RESULT_ROWS, TURN_LOG,
    hours, in_days, labelled, query, r6, rounded, seconds,
)
from dueline.session import scratch_path
from dueline.sources import samples, tables
from dueline.sources.xes import read_xes

E_COLS = "case_id, ts, l_linenumber, l_partkey, l_suppkey"
C_COLS = "case_id, ts"
HORIZON_DAYS = 10


def _order(log, *names):
    return rounded(log.df.select("case_id", "ts", "l_linenumber", "l_partkey", "l_suppkey", *names))


def _click(log, *names):
    return rounded(log.df.select("case_id", "ts", *names))


# -- sources -----------------------------------------------------------------


@query(
    "xes_ingest",
    f"""SELECT user_id AS case_id, event_type AS activity, ts, value,
       json_extract_string(props, '$.k') AS resource,
       row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS event_index
FROM events""",
)
def xes_ingest(spark, folder):
    """Writes the click log as XES, one trace per case, and reads it back.

    A trace is one element of the file by definition of the format, so the
    writer has to gather it; reading spreads its events again.
    """
    log = samples.click_events(spark, folder)

    def attribute(kind, key, value):
        pair = F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))
        return F.array(pair).alias(kind)

    event = F.struct(
        attribute("date", "time:timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")),
        F.array(
            F.struct(F.lit("concept:name").alias("_key"), F.col("activity").alias("_value")),
            F.struct(F.lit("org:resource").alias("_key"), F.col("resource").alias("_value")),
        ).alias("string"),
        attribute("float", "value", F.col("value")),
    )
    traces = log.groupBy("case_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ts", event.alias("e")))), lambda x: x["e"]
        ).alias("event")
    )
    path = scratch_path(spark, "clicks.xes")
    traces.select(attribute("string", "concept:name", F.col("case_id")), "event").write.format(
        "xml"
    ).option("rowTag", "trace").option("rootTag", "log").option("compression", "gzip").save(path)
    events = read_xes(spark, path)
    return rounded(
        events.select(
            F.col("`case:concept:name`").cast("long").alias("case_id"),
            F.col("`concept:name`").alias("activity"),
            F.col("`time:timestamp`").alias("ts"),
            "value",
            F.col("`org:resource`").alias("resource"),
            F.col("event_index").cast("long").alias("event_index"),
        )
    )


@query("log_source", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def log_source(spark, folder):
    """Staged copy of the import, partitioned by year; built on first use."""
    path = scratch_path(spark, "events")
    source = samples.table(spark, folder, "events")
    staged = tables.read_or_build(
        spark, path, lambda: source.withColumn("year", F.year("ts")), ("year",)
    )
    return staged.select(*source.columns)


@query("csv_roundtrip", f"WITH {CLICK_LOG} SELECT case_id, activity, ts, resource, value FROM click_raw")
def csv_roundtrip(spark, folder):
    log = samples.click_events(spark, folder)
    path = scratch_path(spark, "clicks.csv")
    tables.write_csv(log, path)
    return tables.read_csv(spark, path, log.schema)


@query("results_union", f"WITH {RESULT_ROWS} SELECT Classifier, timediff, AUC FROM result_rows")
def results_union(spark, folder):
    """Result files of each classifier, read as one table by their glob."""
    rows = samples.result_rows(spark, folder)
    path = scratch_path(spark, "results")
    for part, keep in (("first", F.col("timediff") < 7), ("second", F.col("timediff") >= 7)):
        tables.write_csv(rows.filter(keep), f"{path}/{part}_results.csv")
    return tables.read_results(spark, path)


# -- filters and projections ---------------------------------------------------


@query(
    "filter_equal",
    f"WITH {ORDER_LOG} SELECT {E_COLS}, activity, l_quantity FROM order_log WHERE status = 'F'",
)
def filter_equal(spark, folder):
    log = samples.order_log(spark, folder).filter(F.col("status") == "F")
    return _order(log, "activity", "l_quantity")


@query(
    "filter_year_match",
    f"WITH {ORDER_LOG} SELECT {E_COLS}, case_year FROM order_log WHERE year(ts) = case_year",
)
def filter_year_match(spark, folder):
    log = samples.order_log(spark, folder).filter(F.year("ts") == F.col("case_year"))
    return _order(log, "case_year")


@query(
    "composite_case_key",
    f"""WITH {ORDER_LOG}
SELECT CAST(case_id AS VARCHAR) || CAST(case_year AS VARCHAR) AS case_id, count(*) AS n_events
FROM order_log GROUP BY 1""",
)
def composite_case_key(spark, folder):
    log = samples.order_log(spark, folder)
    keyed = log.map(lambda d: filters.composite_case_key(d, log.spec, "case_year")).df
    return keyed.groupBy("case_id").agg(F.count("*").alias("n_events"))


@query(
    "cast_columns",
    f"""WITH {CLICK_LOG}
SELECT case_id, ts, CAST(resource AS INTEGER) AS resource_nr,
       CAST(year AS DOUBLE) AS year_number FROM click_raw""",
)
def cast_columns(spark, folder):
    log = samples.click_log(spark, folder).with_columns(
        {
            "resource_nr": F.col("resource").cast("int"),
            "year_number": F.year("ts").cast("double"),
        }
    )
    return _click(log, "resource_nr", "year_number")


@query(
    "cases_intersecting",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, activity FROM order_log WHERE case_id IN (
  SELECT case_id FROM order_log GROUP BY 1
  HAVING min(ts) <= TIMESTAMP '1998-06-30' AND max(ts) >= TIMESTAMP '1998-01-01')""",
)
def cases_intersecting(spark, folder):
    log = filters.cases_intersecting(
        samples.order_log(spark, folder), "1998-01-01", "1998-06-30"
    )
    return _order(log, "activity")


@query(
    "cases_starting_in",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, activity FROM order_log WHERE case_id IN (
  SELECT case_id FROM order_log WHERE event_nr = 1
  AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-03-31')""",
)
def cases_starting_in(spark, folder):
    log = filters.cases_starting_in(samples.order_log(spark, folder), "1996-01-01", "1997-03-31")
    return _order(log, "activity")


@query(
    "cases_starting_from",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, activity FROM order_log WHERE case_id IN (
  SELECT case_id FROM order_log WHERE event_nr = 1 AND ts >= TIMESTAMP '1999-01-01')""",
)
def cases_starting_from(spark, folder):
    log = filters.cases_starting_in(samples.order_log(spark, folder), "1999-01-01")
    return _order(log, "activity")


@query(
    "cases_ending_in",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, activity FROM order_log WHERE case_id IN (
  SELECT case_id FROM order_log GROUP BY 1
  HAVING max(ts) BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31')""",
)
def cases_ending_in(spark, folder):
    log = filters.cases_ending_in(samples.order_log(spark, folder), "2000-01-01", "2000-12-31")
    return _order(log, "activity")


@query(
    "min_activity",
    f"""WITH {TURN_LOG}
SELECT case_id, turn, activity FROM turn_log WHERE case_id IN (
  SELECT case_id FROM turn_log WHERE activity = 'user' GROUP BY 1 HAVING count(*) >= 2)""",
)
def min_activity(spark, folder):
    log = filters.min_activity(samples.turn_log(spark, folder), "user", 2)
    return log.df.select("case_id", "turn", "activity")


@query(
    "prefix_to_pos",
    f"""WITH {CLICK_LOG}, {labelled("click_log", "purchase", "error")}
SELECT case_id, ts, activity, event_nr, pos FROM lab WHERE y = 0 AND event_nr <= pos""",
)
def prefix_to_pos(spark, folder):
    log = _labelled_clicks(spark, folder)
    return filters.prefix_to_position(log, 0).df.select(
        "case_id", "ts", "activity", "event_nr", "pos"
    )


@query(
    "approvals_on_time",
    f"""WITH {ORDER_LOG}, {labelled("order_log", "NO", "RF")}
SELECT {E_COLS}, activity FROM lab WHERE activity = 'NO' AND NOT (y = 1)""",
)
def approvals_on_time(spark, folder):
    log = _labelled_orders(spark, folder).with_columns({"late": F.col("y") == 1})
    return _order(log.filter((F.col("activity") == "NO") & ~F.col("late")), "activity")


@query(
    "semi_split",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, activity FROM order_log
WHERE case_id IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1995, 1996))""",
)
def semi_split(spark, folder):
    cases = samples.order_cases(spark, folder)
    log = samples.order_log(spark, folder)
    ids = filters.case_ids_where(cases, log.spec, F.col("case_year").isin(1995, 1996))
    return _order(log.keep_cases(ids), "activity")


@query(
    "split_by_year",
    f"""WITH {ORDER_LOG}
SELECT DISTINCT case_id, CASE WHEN case_year <= 1998 THEN 'train' ELSE 'test' END AS part
FROM order_log""",
)
def split_by_year(spark, folder):
    log = samples.order_log(spark, folder)
    train, test = filters.split_by_year(
        log.df, log.spec, "case_year", [1995, 1996, 1997, 1998], [1999, 2000, 2001]
    )
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query(
    "deadline_lookup",
    f"WITH {CLICK_LOG} SELECT case_id, ts, year, deadline FROM click_raw",
)
def deadline_lookup(spark, folder):
    return samples.click_log_with_deadline(spark, folder).df.select(
        "case_id", "ts", "year", "deadline"
    )


# -- event features --------------------------------------------------------------


def _labelled_clicks(spark, folder):
    log = features.event_number(samples.click_log_with_deadline(spark, folder))
    return late_payment_label(log, samples.CLICK_BEGIN, samples.CLICK_ABORT)


def _labelled_orders(spark, folder):
    log = features.event_number(samples.order_log(spark, folder))
    return late_payment_label(log, samples.ORDER_BEGIN, samples.ORDER_ABORT)


@query("count_cases", "SELECT count(DISTINCT l_orderkey) AS n_cases FROM lineitem")
def count_cases(spark, folder):
    return features.count_cases(samples.order_events(spark, folder), samples.ORDER_SPEC)


@query(
    "count_cases_approx",
    "SELECT count(DISTINCT l_orderkey) AS n_cases, TRUE AS within_five_errors FROM lineitem",
)
def count_cases_approx(spark, folder):
    """The exact number, and whether the sketch's is within five times its error of 2 %."""
    events = samples.order_events(spark, folder)
    exact = features.count_cases(events, samples.ORDER_SPEC)
    rough = features.count_cases_approx(events, samples.ORDER_SPEC).withColumnRenamed("n_cases", "about")
    off = F.abs(F.col("about") - F.col("n_cases"))
    # One row each.
    return exact.crossJoin(F.broadcast(rough)).select("n_cases", (off <= 0.1 * F.col("n_cases")).alias("within_five_errors"))


@query(
    "activity_count",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, count(*) FILTER (WHERE activity = 'NO') OVER (PARTITION BY case_id) AS "Count NO"
FROM order_log""",
)
def activity_count(spark, folder):
    return _order(features.activity_count(samples.order_log(spark, folder), "NO"), "Count NO")


def _order_feature(name, column, expression):
    sql = f"WITH {ORDER_LOG} SELECT {E_COLS}, {r6(expression, column)} FROM order_log"
    return query(name, sql)


def _click_feature(name, column, expression):
    sql = f"WITH {CLICK_LOG} SELECT {C_COLS}, {r6(expression, column)} FROM click_log"
    return query(name, sql)


_CLICK_NEXT = f"lead(ts) OVER {CLICK_W}"
_CLICK_FIRST = f"first_value(ts) OVER {CLICK_W}"
_CLICK_CASE = "OVER (PARTITION BY case_id)"


@_click_feature("event_duration", "duration", hours("ts", _CLICK_NEXT))
def event_duration(spark, folder):
    return _click(features.event_duration(samples.click_log(spark, folder)), "duration")


@_click_feature(
    "time_since_last",
    "time_since_last_event",
    f"coalesce({seconds(f'lag(ts) OVER {CLICK_W}', 'ts')}, 0)",
)
def time_since_last(spark, folder):
    log = features.time_since_last_event(samples.click_log(spark, folder))
    return _click(log, "time_since_last_event")


@_click_feature("time_since_first", "time_since_first_event", seconds(_CLICK_FIRST, "ts"))
def time_since_first(spark, folder):
    log = features.time_since_first_event(samples.click_log(spark, folder))
    return _click(log, "time_since_first_event")


@query(
    "cumulative_duration",
    f"""WITH {CLICK_LOG},
d AS (SELECT *, date_diff('microsecond', ts, {_CLICK_NEXT}) AS gap FROM click_log)
SELECT {C_COLS}, CASE WHEN gap IS NOT NULL
  THEN round(CAST(sum(gap) OVER {CLICK_W} AS DOUBLE) / 3.6e9, 6) + 0.0 END AS cumulative_duration
FROM d""",
)
def cumulative_duration(spark, folder):
    log = features.cumulative_duration(samples.click_log(spark, folder))
    return _click(log, "cumulative_duration")


@query(
    "total_duration",
    f"""WITH {ORDER_LOG},
d AS (SELECT *, {hours("ts", f"lead(ts) OVER {ORDER_W}")} AS duration FROM order_log)
SELECT {E_COLS}, {r6("coalesce(sum(duration) OVER (PARTITION BY case_id), 0)", "total_duration")}
FROM d""",
)
def total_duration(spark, folder):
    log = features.total_duration(samples.order_log(spark, folder))
    return _order(log, "total_duration")


@query(
    "time_attributes",
    f"""WITH {CLICK_LOG}
SELECT {C_COLS}, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(dayofyear(ts) AS INTEGER) AS dayofyear FROM click_log""",
)
def time_attributes(spark, folder):
    log = features.time_attributes(samples.click_log(spark, folder))
    return _click(log, "year", "month", "weekday", "hour", "dayofyear")


@query(
    "seq_length",
    f"""WITH {TURN_LOG}
SELECT case_id, turn, count(*) OVER (PARTITION BY case_id) AS trace_length FROM turn_log""",
)
def seq_length(spark, folder):
    log = features.trace_length(samples.turn_log(spark, folder))
    return log.df.select("case_id", "turn", "trace_length")


@query("event_nr", f"WITH {ORDER_LOG} SELECT {E_COLS}, event_nr FROM order_log")
def event_nr(spark, folder):
    return _order(features.event_number(samples.order_log(spark, folder)), "event_nr")


@_click_feature("remaining_time", "remaining_time", in_days("ts", f"max(ts) {_CLICK_CASE}"))
def remaining_time(spark, folder):
    return _click(features.remaining_time(samples.click_log(spark, folder)), "remaining_time")


@query(
    "remaining_bus_days",
    f"""WITH {CLICK_LOG}, {DAYS},
e AS (SELECT *, max(ts) {_CLICK_CASE} AS end_timestamp FROM click_log),
m AS (
  SELECT case_id, ts, end_timestamp, {in_days("ts", "end_timestamp")} AS rt,
         CAST(floor({in_days("ts", "end_timestamp")}) AS INTEGER) AS days_count,
         CAST(b.wd - a.wd AS INTEGER) AS bus_days_between
  FROM e JOIN days a ON a.d = CAST(ts AS DATE) JOIN days b ON b.d = CAST(end_timestamp AS DATE))
SELECT case_id, ts, end_timestamp, {r6("rt", "remaining_time")}, days_count, bus_days_between,
       days_count - bus_days_between AS holidays,
       {r6("rt - (days_count - bus_days_between)", '"remaining bus. hours / 24"')} FROM m""",
)
def remaining_bus_days(spark, folder):
    log = features.remaining_business_days(samples.click_log(spark, folder)).df
    return rounded(
        log.select(
            "case_id", "ts", "end_timestamp", "remaining_time", "days_count", "bus_days_between",
            "holidays", f"`{features.REMAINING_BUSINESS_TIME}`",
        )
    )


@query(
    "label_broadcast",
    f"""WITH {ORDER_LOG}
SELECT {E_COLS}, last_value(flag IGNORE NULLS) OVER (
  PARTITION BY case_id ORDER BY ts, l_linenumber, l_partkey, l_suppkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS flag FROM order_log""",
)
def label_broadcast(spark, folder):
    return _order(features.spread_last(samples.order_log(spark, folder), "flag"), "flag")


@query(
    "case_start",
    f"""WITH {CLICK_LOG} SELECT {C_COLS}, min(ts) {_CLICK_CASE} AS "StartTime" FROM click_log""",
)
def case_start(spark, folder):
    return _click(features.case_start(samples.click_log(spark, folder)), "StartTime")


# -- calendar -------------------------------------------------------------------


@query(
    "business_day_offset",
    f"""WITH {DAYS},
target AS (
  SELECT a.d, CAST(range AS INTEGER) AS horizon, w.d AS latest
  FROM days a CROSS JOIN range(15) JOIN workdays w ON w.wd = a.wd - range)
SELECT o_orderkey, horizon,
       o_orderdate + to_days(CAST(date_diff('day', t.d, t.latest) AS INTEGER)) AS latest
FROM orders JOIN target t ON t.d = CAST(o_orderdate AS DATE)""",
)
def business_day_offset(spark, folder):
    """Latest moment for each of 15 horizons before each order date."""
    orders = samples.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    each = orders.withColumn("horizon", F.explode(F.sequence(F.lit(0), F.lit(14))))
    latest = calendar.minus_business_days(F.col("o_orderdate"), F.col("horizon"))
    return each.select("o_orderkey", "horizon", latest.alias("latest"))


@query(
    "busday_count",
    f"""WITH {ORDER_LOG}, {DAYS}
SELECT {E_COLS}, CAST(CASE WHEN b.d >= a.d THEN b.wd - a.wd ELSE b1.wd - a1.wd END AS INTEGER)
  AS business_days
FROM order_log
JOIN days a ON a.d = CAST(ts AS DATE) JOIN days b ON b.d = CAST(deadline AS DATE)
JOIN days a1 ON a1.d = a.d + 1 JOIN days b1 ON b1.d = b.d + 1""",
)
def busday_count(spark, folder):
    log = samples.order_log(spark, folder)
    days = calendar.business_days_between(F.col("ts"), F.col("deadline"))
    return _order(log.with_columns({"business_days": days}), "business_days")


# Days off of the next query: the first and the last week of each year, and a day in May.
_DAYS_OFF = [
    date(y, m, d) for y in range(1991, 2003) for m, d in ((1, 1), (1, 2), (5, 1), (12, 24), (12, 25), (12, 26))
]


@query(
    "busday_holidays",
    f"""WITH {ORDER_LOG},
off AS (SELECT make_date(y, md // 100, md % 100) AS d
        FROM range(1991, 2003) r(y), (SELECT unnest([101, 102, 501, 1224, 1225, 1226]) AS md)),
c AS (SELECT d, isodow(d) < 6 AND d NOT IN (SELECT d FROM off) AS work
      FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2004-01-01', INTERVAL 1 DAY)) AS DATE) AS d)),
n AS (SELECT d, work, coalesce(count(*) FILTER (WHERE work)
      OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
w AS (SELECT d, k FROM n WHERE work)
SELECT {E_COLS}, CAST(CASE WHEN b.d >= a.d THEN b.k - a.k ELSE b1.k - a1.k END AS INTEGER) AS business_days,
       deadline + to_days(CAST(w.d - b.d AS INTEGER)) AS start_by
FROM order_log
JOIN n a ON a.d = CAST(ts AS DATE) JOIN n b ON b.d = CAST(deadline AS DATE)
JOIN n a1 ON a1.d = a.d + 1 JOIN n b1 ON b1.d = b.d + 1
JOIN w ON w.k = b.k - {HORIZON_DAYS}""",
)
def busday_holidays(spark, folder):
    """Workdays to the deadline, and the moment ten of them before it, with days off."""
    log = samples.order_log(spark, folder)
    off = calendar.Holidays(_DAYS_OFF)
    made = {
        "business_days": calendar.business_days_between(F.col("ts"), F.col("deadline"), off),
        "start_by": calendar.minus_business_days(F.col("deadline"), HORIZON_DAYS, off),
    }
    return _order(log.with_columns(made), *made)


@query(
    "busdays_inclusive",
    f"""WITH {CLICK_LOG}, {DAYS},
s AS (
  SELECT case_id, ts, deadline, a.wd AS wa,
         CASE WHEN a.work THEN (SELECT max(w.d) FROM workdays w WHERE w.d <= CAST(deadline AS DATE))
              ELSE CAST(deadline AS DATE) END AS last_day
  FROM click_log JOIN days a ON a.d = CAST(ts AS DATE)),
t AS (
  SELECT *, CASE WHEN CAST(ts AS TIME) > CAST(deadline AS TIME) THEN last_day
            ELSE last_day + 1 END AS stop FROM s)
SELECT case_id, ts, CAST(greatest(b.wd - wa, 0) - 1 AS INTEGER) AS business_days
FROM t JOIN days b ON b.d = t.stop""",
)
def busdays_inclusive(spark, folder):
    log = samples.click_log_with_deadline(spark, folder)
    days = calendar.business_days_left(F.col("ts"), F.col("deadline"))
    return _click(log.with_columns({"business_days": days}), "business_days")


@query(
    "payment_run",
    """SELECT event_id, ts, nullif(event_type, 'error') AS event_type,
       CASE WHEN event_type <> 'error' THEN ts + to_days(CAST((12 - isodow(ts)) % 7 AS INTEGER)) END
         AS payment_run
FROM events""",
)
def payment_run(spark, folder):
    """First Friday on or after each event; null for events without a date."""
    events = samples.table(spark, folder, "events")
    due = F.when(F.col("event_type") != "error", F.col("ts"))
    return events.select(
        "event_id",
        "ts",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        calendar.friday_on_or_after(due).alias("payment_run"),
    )
