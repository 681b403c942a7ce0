"""Queries for the descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dueline.operators import features
from dueline.operators.labeling import late_payment_label
from dueline.plans import reports
from dueline.plans.registry import (
    CLICK_LOG, DAYS, ORDER_LOG, RESULT_ROWS, in_days, labelled, query, r6, rounded,
)
from dueline.session import staged
from dueline.sources import samples

_LAST_EVENT = f"""WITH {ORDER_LOG}, {labelled("order_log", "NO", "RF")}, {DAYS},
p AS (
  SELECT case_id, event_nr, CAST(year(ts) AS INTEGER) AS year,
         CAST(CASE WHEN b.d >= a.d THEN b.wd - a.wd ELSE b1.wd - a1.wd END AS INTEGER) AS signed
  FROM lab
  JOIN days a ON a.d = CAST(deadline AS DATE) JOIN days b ON b.d = CAST(ts AS DATE)
  JOIN days a1 ON a1.d = a.d + 1 JOIN days b1 ON b1.d = b.d + 1
  WHERE y = 0 AND event_nr <= pos),
last AS (SELECT case_id, arg_max(signed, event_nr) AS signed, arg_max(year, event_nr) AS year
         FROM p GROUP BY 1)"""


def _last_events(spark, folder):
    log = features.event_number(samples.order_log(spark, folder))
    log = late_payment_label(log, samples.ORDER_BEGIN, samples.ORDER_ABORT)
    return reports.last_event_business_days(log.with_columns({"year": F.year("ts")}))


@query(
    "last_event_busdays",
    f"""{_LAST_EVENT}
SELECT case_id, signed, year, -signed AS business_days_until_deadline FROM last""",
)
def last_event_busdays(spark, folder):
    return _last_events(spark, folder)


@query(
    "busdays_freq",
    f"{_LAST_EVENT} SELECT year, signed, count(*) AS n FROM last GROUP BY 1, 2",
)
def busdays_freq(spark, folder):
    return reports.frequencies(_last_events(spark, folder), "year", "signed")


# Approvals in time: purchases of users without a later error, up to the lookup
# deadline.
_APPROVALS = f"""WITH {CLICK_LOG}, {labelled("click_log", "purchase", "error")}, {DAYS},
s AS (
  SELECT *, a.wd AS wa,
         CASE WHEN a.work THEN (SELECT max(w.d) FROM workdays w WHERE w.d <= CAST(deadline AS DATE))
              ELSE CAST(deadline AS DATE) END AS last_day
  FROM lab JOIN days a ON a.d = CAST(ts AS DATE) WHERE activity = 'purchase' AND y = 0),
t AS (SELECT *, CASE WHEN CAST(ts AS TIME) > CAST(deadline AS TIME) THEN last_day
                ELSE last_day + 1 END AS stop FROM s),
v AS (SELECT case_id, ts, CAST(greatest(b.wd - wa, 0) - 1 AS INTEGER) AS v
      FROM t JOIN days b ON b.d = t.stop)"""


def _approvals(spark, folder):
    log = samples.click_log_with_deadline(spark, folder)
    log = late_payment_label(log, samples.CLICK_BEGIN, samples.CLICK_ABORT)
    log = log.with_columns({"late": F.col("y") == 1})
    return reports.approvals_in_time(log.df, log.spec, samples.CLICK_BEGIN, "late")


_DAYS_LEFT = "business_days_until_deadline"


@query(
    "busdays_hist",
    f"""{_APPROVALS},
h AS (SELECT v AS bin, count(*) AS n FROM v WHERE v >= 0 GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n
FROM range((SELECT CAST(max(bin) + 1 AS BIGINT) FROM h)) LEFT JOIN h ON bin = range""",
)
def busdays_hist(spark, folder):
    return reports.unit_histogram(_approvals(spark, folder), _DAYS_LEFT)


@query(
    "busdays_hist20",
    f"""{_LAST_EVENT},
m AS (SELECT min(signed) AS lo, max(signed) AS hi FROM last),
h AS (SELECT least((signed - lo) * 20 // greatest(hi - lo, 1), 19) AS bin, count(*) AS n
      FROM last, m GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n
FROM range(20) LEFT JOIN h ON bin = range""",
)
def busdays_hist20(spark, folder):
    return reports.equal_histogram(_last_events(spark, folder), "signed", 20)


@query(
    "value_hist",
    """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 25), 24) AS bin, count(*) AS n
      FROM lineitem, m GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(25) LEFT JOIN h ON bin = range""",
)
def value_hist(spark, folder):
    return reports.equal_histogram(samples.table(spark, folder, "lineitem"), "l_extendedprice", 25)


@query(
    "busdays_describe",
    f"""{_APPROVALS}
SELECT count(v) AS count, {r6("avg(v)", "mean")}, {r6("stddev_samp(v)", "std")}, min(v) AS min,
       {r6("quantile_cont(v, 0.25)", "q25")}, {r6("quantile_cont(v, 0.5)", "q50")},
       {r6("quantile_cont(v, 0.75)", "q75")}, max(v) AS max FROM v""",
)
def busdays_describe(spark, folder):
    return rounded(reports.describe(_approvals(spark, folder), _DAYS_LEFT))


@query(
    "busdays_ranges",
    f"""{_APPROVALS}
SELECT {", ".join(r6(f"count(*) FILTER (WHERE v BETWEEN {a} AND {b}) / CAST(count(*) AS DOUBLE) * 100",
                     f"d{a}_{b}") for a, b in reports.DAY_RANGES)} FROM v""",
)
def busdays_ranges(spark, folder):
    return rounded(reports.range_shares(_approvals(spark, folder), _DAYS_LEFT))


_BY_STATE = f"""WITH {CLICK_LOG}, {labelled("click_log", "purchase", "error")}, {DAYS},
p AS (SELECT case_id, ts, activity, event_nr, max(ts) OVER (PARTITION BY case_id) AS fin
      FROM lab WHERE y = 1 AND event_nr <= pos),
q AS (
  SELECT case_id, activity, event_nr,
         {in_days("ts", "fin")} - (CAST(floor({in_days("ts", "fin")}) AS INTEGER) - (b.wd - a.wd))
           AS remaining
  FROM p JOIN days a ON a.d = CAST(ts AS DATE) JOIN days b ON b.d = CAST(fin AS DATE)),
bystate AS (SELECT case_id, activity AS state, arg_min(remaining, event_nr) AS remaining FROM q
            WHERE activity IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2)"""


def _by_state(spark, folder):
    log = samples.click_log(spark, folder)
    log = late_payment_label(features.event_number(log), samples.CLICK_BEGIN, samples.CLICK_ABORT)
    return reports.remaining_by_state(log, samples.CLICK_STATES)


@query(
    "remaining_by_state",
    f"{_BY_STATE} SELECT case_id, state, {r6('remaining', 'remaining')} FROM bystate",
)
def remaining_by_state(spark, folder):
    return rounded(_by_state(spark, folder))


@query(
    "state_stats",
    f"""{_BY_STATE}
SELECT state, {r6("quantile_cont(remaining, 0.5)", "median")}, {r6("avg(remaining)", "mean")},
       {r6("stddev_samp(remaining)", "std")} FROM bystate GROUP BY 1""",
)
def state_stats(spark, folder):
    return rounded(reports.state_stats(_by_state(spark, folder)))


def _share_sql(score: str, name: str) -> str:
    low = f"count(*) FILTER (WHERE remaining < {score})"
    upto = f"count(*) FILTER (WHERE remaining <= {score})"
    extra = f"CASE WHEN {low} < {upto} THEN 1 ELSE 0 END"
    return r6(f"({low} + {upto} + {extra}) * CAST(50 AS DOUBLE) / count(*)", name)


@query(
    "percentile_of_score",
    f"""{_BY_STATE}
SELECT {_share_sql("CAST(1 AS DOUBLE)", "one_day")},
       {_share_sql("CAST(1 AS DOUBLE) / 24", "one_hour")},
       {_share_sql("CAST(0 AS DOUBLE)", "none")} FROM bystate WHERE state = 'purchase'""",
)
def percentile_of_score(spark, folder):
    last_state = _by_state(spark, folder).filter(F.col("state") == samples.CLICK_STATES[-1])
    scores = {"one_day": 1.0, "one_hour": 1 / 24, "none": 0.0}
    return rounded(reports.percentile_of_score(last_state, "remaining", scores))


_BOX = f"""{_BY_STATE},
q AS (SELECT state, quantile_cont(remaining, 0.25) AS q1, quantile_cont(remaining, 0.5) AS med,
             quantile_cont(remaining, 0.75) AS q3 FROM bystate GROUP BY 1),
j AS (SELECT *, remaining BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM bystate JOIN q USING (state))""".replace("q AS (\n  SELECT case_id", "rem AS (\n  SELECT case_id").replace(
    "FROM q\n", "FROM rem\n"
)


@query(
    "state_box",
    f"""{_BOX}
SELECT state, {r6("q1", "q1")}, {r6("med", "med")}, {r6("q3", "q3")},
       {r6("min(remaining) FILTER (WHERE inside)", "low")},
       {r6("max(remaining) FILTER (WHERE inside)", "high")},
       count(*) FILTER (WHERE NOT inside) AS outliers FROM j GROUP BY state, q1, med, q3""",
)
def state_box(spark, folder):
    return rounded(reports.state_box(_by_state(spark, folder)))


@query(
    "state_outliers",
    f"{_BOX} SELECT state, case_id, {r6('remaining', 'remaining')} FROM j WHERE NOT inside",
)
def state_outliers(spark, folder):
    by_state = staged(_by_state(spark, folder), "by_state")
    return rounded(reports.state_outliers(by_state, reports.state_box(by_state)))


@query(
    "log_statistics",
    f"""WITH {ORDER_LOG}, {labelled("order_log", "NO", "RF")},
e AS (SELECT case_id, activity, ts, resource, l_linenumber, l_quantity, l_extendedprice,
             o_orderpriority, deadline, event_nr, y = 1 AS late FROM lab),
c AS (SELECT case_id, count(*) AS n, CAST(arg_max(late, event_nr) AS INTEGER) AS late
      FROM e GROUP BY 1),
d AS (SELECT count(DISTINCT case_id) AS n, [count(DISTINCT case_id), count(DISTINCT activity),
        count(DISTINCT ts), count(DISTINCT resource), count(DISTINCT l_linenumber),
        count(DISTINCT l_quantity), count(DISTINCT l_extendedprice),
        count(DISTINCT o_orderpriority), count(DISTINCT deadline), count(DISTINCT event_nr),
        count(DISTINCT late)] AS k, count(DISTINCT activity) AS acts FROM e)
SELECT 'n_cases' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'positive_class_ratio', round(avg(late), 6) FROM c
UNION ALL SELECT 'median_trace_length', CAST(median(n) AS DOUBLE) FROM c
UNION ALL SELECT 'n_numerical_attributes', CAST(5 AS DOUBLE)
UNION ALL SELECT 'n_case_attributes', CAST(len(list_filter(k, lambda x: x = n)) AS DOUBLE) FROM d
UNION ALL SELECT 'n_cat_event_attributes', CAST(2 AS DOUBLE)
UNION ALL SELECT 'n_activity_classes', CAST(acts AS DOUBLE) FROM d""",
)
def log_statistics(spark, folder):
    log = features.event_number(samples.order_log(spark, folder))
    log = late_payment_label(log, samples.ORDER_BEGIN, samples.ORDER_ABORT)
    kept = log.df.select(
        "case_id", "activity", "ts", "resource", "l_linenumber", "l_quantity", "l_extendedprice",
        "o_orderpriority", "deadline", "event_nr", (F.col("y") == 1).alias("late"),
    )
    by_number = log.spec.but(order_by=("event_nr",))
    return rounded(reports.log_statistics(kept, by_number, "late"))


@query(
    "log_summary",
    f"""WITH {CLICK_LOG}, {labelled("click_log", "purchase", "error")},
c AS (SELECT case_id, count(*) AS n, max(y) AS late FROM lab GROUP BY 1)
SELECT 'cases' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'events', CAST(sum(n) AS DOUBLE) FROM c
UNION ALL SELECT 'mean_events', round(avg(n), 6) FROM c
UNION ALL SELECT 'median_events', CAST(median(n) AS DOUBLE) FROM c
UNION ALL SELECT 'positive_ratio', round(avg(late), 6) FROM c
UNION ALL SELECT 'activity_classes', CAST(count(DISTINCT activity) AS DOUBLE) FROM lab""",
)
def log_summary(spark, folder):
    log = late_payment_label(
        samples.click_log(spark, folder), samples.CLICK_BEGIN, samples.CLICK_ABORT
    )
    return rounded(reports.log_summary(log.df, log.spec, "y"))


_CLASSIFIERS = ("click", "error", "purchase", "signup", "view")


@query(
    "leaderboard_pivot",
    f"""WITH {RESULT_ROWS}
SELECT timediff, {", ".join(f"max(AUC) FILTER (WHERE Classifier = '{c}') AS {c}" for c in _CLASSIFIERS)}
FROM result_rows WHERE timediff < 15 GROUP BY 1 ORDER BY 1""",
)
def leaderboard_pivot(spark, folder):
    return reports.leaderboard(samples.result_rows(spark, folder), list(_CLASSIFIERS))
