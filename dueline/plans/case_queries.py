"""Queries for labels, cuts, encoding and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from dueline.operators import cutting, encoding, features, filters, horizons, splits
from dueline.operators.labeling import late_payment_label
from dueline.plans.registry import (
    CLICK_LOG, DAYS, ORDER_LOG, TURN_LOG, cut, hours, in_days, labelled, query, r6, rounded,
    seconds,
)
from dueline.plans.workflow import labelled_log, train_test_rows
from dueline.sources import samples

HORIZON = 7
ACTIVITIES = ("AF", "AO", "NF", "NO", "RF", "RO")
FLAGS = ("A", "R")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O")
ORDER_DEADLINES = {y: f"{y}-12-22" for y in range(1995, 2002)}


def labelled_orders(spark, folder):
    log = samples.order_log(spark, folder).numbered()
    return late_payment_label(log, samples.ORDER_BEGIN, samples.ORDER_ABORT)


def cut_orders(spark, folder, business_days=HORIZON):
    return cutting.cut_before_deadline(samples.order_log(spark, folder), business_days)


# -- SQL for the encoded columns -------------------------------------------------


def _code(column: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CASE {column} {whens} ELSE -1 END"


def _sql_numeric() -> list[str]:
    out = []
    for c in samples.ORDER_SPEC.numeric:
        v = f"coalesce({c}, 0.0)"
        out += [
            r6(f"avg({v})", f"{c}_mean"),
            r6(f"max({v})", f"{c}_max"),
            r6(f"min({v})", f"{c}_min"),
            r6(f"sum({v})", f"{c}_sum"),
            r6(f"coalesce(stddev_samp({v}), 0)", f"{c}_std"),
        ]
    return out


def _sql_dynamic() -> list[str]:
    out = []
    for c, values in (("activity", ACTIVITIES), ("flag", FLAGS)):
        out += [f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{v}" for v in values]
        out.append(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nan")
    return out


def _sql_static() -> list[str]:
    return [
        f"arg_min({_code('o_orderpriority', PRIORITIES)}, event_nr) AS o_orderpriority",
        f"arg_min({_code('status', STATUSES)}, event_nr) AS status",
    ]


def _sql_encoded(source: str, columns: list[str], more: str = "") -> str:
    return f"SELECT case_id, {', '.join(columns)}{more} FROM {source} GROUP BY case_id"


_CUT_ORDERS = f"WITH {ORDER_LOG}, {DAYS}, {cut('order_log', HORIZON)}"


# -- labels and cuts ---------------------------------------------------------------


@query(
    "late_label",
    f"""WITH {ORDER_LOG}, {labelled("order_log", "NO", "RF")}
SELECT DISTINCT case_id, y, pos FROM lab""",
)
def late_label(spark, folder):
    log = labelled_orders(spark, folder)
    return log.df.groupBy("case_id").agg(F.max("y").alias("y"), F.max("pos").alias("pos"))


@query(
    "late_label_turns",
    f"""WITH {TURN_LOG}, {labelled("turn_log", "assistant", "system")}
SELECT case_id, turn, activity, y, pos FROM lab""",
)
def late_label_turns(spark, folder):
    log = late_payment_label(samples.turn_log(spark, folder), "assistant", "system")
    return log.df.select("case_id", "turn", "activity", "y", "pos")


@query(
    "state_bucket",
    f"""WITH {CLICK_LOG},
s AS (SELECT case_id, min(event_nr) AS state FROM click_log WHERE activity = 'signup' GROUP BY 1)
SELECT case_id, ts, activity, event_nr, state FROM click_log JOIN s USING (case_id)
WHERE event_nr <= state""",
)
def state_bucket(spark, folder):
    log = cutting.cut_at_state(samples.click_log(spark, folder), "signup")
    return log.df.select("case_id", "ts", "activity", "event_nr", "state")


@query(
    "time_bucket",
    f"{_CUT_ORDERS} SELECT case_id, ts, l_linenumber, l_partkey, l_suppkey, activity FROM cut",
)
def time_bucket(spark, folder):
    return cut_orders(spark, folder).df.select(
        "case_id", "ts", "l_linenumber", "l_partkey", "l_suppkey", "activity"
    )


@query(
    "horizon_sweep",
    f"""WITH {ORDER_LOG}, {DAYS},
target AS (
  SELECT a.d, CAST(range AS INTEGER) AS horizon, w.d AS latest
  FROM days a CROSS JOIN range(15) JOIN workdays w ON w.wd = a.wd - range),
s AS (
  SELECT horizon, case_id, l_quantity FROM order_log g
  JOIN target t ON t.d = CAST(g.deadline AS DATE)
  WHERE g.ts <= g.deadline + to_days(CAST(date_diff('day', t.d, t.latest) AS INTEGER)))
SELECT horizon, count(DISTINCT case_id) AS n_cases, count(*) AS n_events,
       {r6("sum(l_quantity)", "sum_l_quantity")} FROM s GROUP BY 1""",
)
def horizon_sweep(spark, folder):
    log = samples.order_log(spark, folder)
    return rounded(cutting.horizon_sweep(log.df, log.spec, 15, ("l_quantity",)))


# -- encoding ------------------------------------------------------------------------


def _encode(log, **more):
    return encoding.CaseEncoder.for_spec(log.spec, labelCol="", **more).fit(log.df).transform(log.df)


@query("agg_numeric", f"{_CUT_ORDERS} {_sql_encoded('cut', _sql_numeric())}")
def agg_numeric(spark, folder):
    return rounded(_encode(cut_orders(spark, folder).with_spec(dynamic=(), static=())))


@query("agg_dynamic", f"WITH {ORDER_LOG} {_sql_encoded('order_log', _sql_dynamic())}")
def agg_dynamic(spark, folder):
    return _encode(samples.order_log(spark, folder).with_spec(numeric=(), static=()))


@query(
    "dynamic_counts",
    f"""WITH {ORDER_LOG}
SELECT case_id, 'resource' AS "column", resource AS value, count(*) AS n FROM order_log GROUP BY 1, 3
UNION ALL
SELECT case_id, 'flag' AS "column", flag AS value, count(*) AS n FROM order_log GROUP BY 1, 3""",
)
def dynamic_counts(spark, folder):
    """The long form, for columns with any number of values."""
    log = samples.order_log(spark, folder)
    return encoding.dynamic_counts(log.df, log.spec.but(dynamic=("resource", "flag")))


@query("static_codes", f"WITH {ORDER_LOG} {_sql_encoded('order_log', _sql_static())}")
def static_codes(spark, folder):
    return _encode(samples.order_log(spark, folder).with_spec(numeric=(), dynamic=()))


def _sql_one_hot() -> str:
    flags = []
    for c, codes in (("o_orderpriority", range(5)), ("status", range(-1, 2))):
        flags += [f'CASE WHEN {c} = {k} THEN 1 ELSE 0 END AS "{c}_{k}"' for k in codes]
        flags.append(f"0 AS {c}_nan")
    return ", ".join(flags)


@query(
    "static_onehot",
    f"""WITH {ORDER_LOG}, c AS ({_sql_encoded("order_log", _sql_static())})
SELECT case_id, {_sql_one_hot()} FROM c""",
)
def static_onehot(spark, folder):
    log = samples.order_log(spark, folder).with_spec(numeric=(), dynamic=())
    return _encode(log, oneHotStatic=True)


@query(
    "case_features",
    f"""WITH {ORDER_LOG}, {DAYS}, {labelled("order_log", "NO", "RF")}, {cut("lab", HORIZON)}
{_sql_encoded("cut", [*_sql_numeric(), *_sql_dynamic(), *_sql_static()], ", arg_max(y, event_nr) AS y")}""",
)
def case_features(spark, folder):
    """Late orders: label, cut a week of workdays early, one row per order."""
    log = cutting.cut_before_deadline(labelled_orders(spark, folder), HORIZON)
    encoder = encoding.CaseEncoder.for_spec(log.spec)
    return rounded(encoder.fit(log.df).transform(log.df))


@query(
    "horizon_features",
    f"""WITH {ORDER_LOG}, {DAYS}, {labelled("order_log", "NO", "RF")},
target AS (
  SELECT a.d, CAST(range AS INTEGER) AS horizon, w.d AS latest
  FROM days a CROSS JOIN range(15) JOIN workdays w ON w.wd = a.wd - range),
cut AS (
  SELECT g.*, horizon FROM lab g JOIN target t ON t.d = CAST(g.deadline AS DATE)
  WHERE g.ts <= g.deadline + to_days(CAST(date_diff('day', t.d, t.latest) AS INTEGER)))
SELECT horizon, case_id,
       {", ".join([*_sql_numeric(), *_sql_dynamic(), *_sql_static()])}, arg_max(y, event_nr) AS y
FROM cut GROUP BY horizon, case_id""",
)
def horizon_features(spark, folder):
    """Feature rows of late orders at horizons 0 to 14, from one scan of the log."""
    log = labelled_orders(spark, folder)
    models = horizons.fit_horizons(log.df, log.spec, range(15))
    return rounded(horizons.horizon_rows(log.df, log.spec, models))


@query(
    "feature_cardinality",
    f"""WITH {ORDER_LOG}, c AS ({_sql_encoded("order_log", _sql_static())}),
f AS (SELECT 'o_orderpriority' AS feature, count(DISTINCT o_orderpriority) AS n_values FROM c
      UNION ALL SELECT 'status', count(DISTINCT status) FROM c)
SELECT feature, n_values, n_values // 2 + 1 AS embedding_size FROM f""",
)
def feature_cardinality(spark, folder):
    log = samples.order_log(spark, folder).with_spec(numeric=(), dynamic=())
    return encoding.feature_cardinality(_encode(log), list(log.spec.static))


def year_split(spark, folder, spec):
    return filters.split_by_year(
        samples.order_cases(spark, folder), spec, "case_year", [1995, 1996, 1997, 1998],
        [1999, 2000, 2001],
    )


@query(
    "train_test_counts",
    f"""WITH {ORDER_LOG}, {DAYS}, {labelled("order_log", "NO", "RF")}, {cut("lab", HORIZON)},
c AS (SELECT case_id, max(case_year) AS case_year, arg_max(y, event_nr) AS y,
             sum(l_quantity) AS q, count(*) FILTER (WHERE activity = 'NO') AS a,
             arg_min(status, event_nr) AS s FROM cut GROUP BY 1)
SELECT CASE WHEN case_year <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n_cases,
       CAST(sum(y) AS BIGINT) AS n_late, {r6("sum(q)", "quantity")},
       CAST(sum(a) AS BIGINT) AS n_no, count(*) FILTER (WHERE s = 'F') AS n_f
FROM c GROUP BY 1""",
)
def train_test_counts(spark, folder):
    log = labelled_orders(spark, folder)
    sides = train_test_rows(log, HORIZON, *year_split(spark, folder, log.spec))
    named = [
        s.withColumn("part", F.lit(n)) for n, s in (("train", sides.train), ("test", sides.test))
    ]
    return rounded(
        named[0]
        .unionByName(named[1])
        .groupBy("part")
        .agg(
            F.count("*").alias("n_cases"),
            F.sum("y").alias("n_late"),
            F.sum("l_quantity_sum").alias("quantity"),
            F.sum("activity_NO").alias("n_no"),
            F.sum("status_0").alias("n_f"),
        )
    )


_W = "(PARTITION BY case_id ORDER BY ts, l_linenumber, l_partkey, l_suppkey)"


@query(
    "labelled_log",
    f"""WITH {ORDER_LOG},
k AS (SELECT * EXCLUDE (case_id, event_nr, deadline),
             CAST(case_id AS VARCHAR) || CAST(case_year AS VARCHAR) AS case_id
      FROM order_log WHERE status = 'F' AND year(ts) = case_year),
e AS (SELECT *, row_number() OVER {_W} AS event_nr FROM k),
{labelled("e", "NO", "RF")},
g AS (SELECT *, lag(ts) OVER {_W} AS prev, lead(ts) OVER {_W} AS next,
             first_value(ts) OVER {_W} AS start, max(ts) OVER (PARTITION BY case_id) AS fin,
             count(*) OVER (PARTITION BY case_id) AS trace_length FROM lab)
SELECT case_id, ts, l_linenumber, l_partkey, l_suppkey, activity, case_year,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(dayofyear(ts) AS INTEGER) AS dayofyear,
  {r6(f"coalesce({seconds('prev', 'ts')}, 0)", "time_since_last_event")},
  {r6(seconds("start", "ts"), "time_since_first_event")}, event_nr,
  {r6(hours("ts", "next"), "duration")}, {r6(in_days("ts", "fin"), "remaining_time")},
  {r6(hours("start", "fin"), "total_duration")}, y, pos, trace_length,
  CAST(CAST(year(ts) AS VARCHAR) || '-12-22' AS TIMESTAMP) AS deadline
FROM g""",
)
def labelled_orders_log(spark, folder):
    spec = samples.ORDER_SPEC
    events = samples.order_log(spark, folder).df.drop("deadline")
    log = labelled_log(
        events, spec, ("status", "F"), "case_year", samples.ORDER_BEGIN, samples.ORDER_ABORT,
        ORDER_DEADLINES,
    )
    return rounded(
        log.df.select(
            "case_id", "ts", "l_linenumber", "l_partkey", "l_suppkey", "activity", "case_year",
            "year", "month", "weekday", "hour", "dayofyear", "time_since_last_event",
            "time_since_first_event", "event_nr", "duration", "remaining_time", "total_duration",
            "y", "pos", "trace_length", "deadline",
        )
    )


# -- splits ----------------------------------------------------------------------------


@query(
    "temporal_split",
    f"""WITH {ORDER_LOG},
c AS (SELECT case_id, max(ts) AS case_end FROM order_log GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY case_end, case_id) - 1 AS position,
             count(*) OVER () AS n FROM c)
SELECT case_id, case_end, position,
       CASE WHEN position >= n - ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM n""",
)
def temporal_split(spark, folder):
    log = samples.order_log(spark, folder)
    return splits.temporal_split(log.df, log.spec, 0.2, positions=True)


_CUTOFF = f"""WITH {ORDER_LOG},
c AS (SELECT case_id, min(ts) AS s FROM order_log GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY s, case_id) - 1 AS position,
             count(*) OVER () AS n FROM c),
k AS (SELECT s AS cutoff FROM n WHERE position = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)),
e AS (SELECT g.*, c.s AS "StartTime", cutoff,
             CASE WHEN c.s >= cutoff THEN 'test' WHEN ts < cutoff THEN 'train' END AS part
      FROM order_log g JOIN c USING (case_id) CROSS JOIN k)"""


def _both_sides(spark, folder):
    train, test = splits.cutoff_split(samples.order_log(spark, folder), 0.8)
    return train, test


@query(
    "cutoff_split",
    f"""{_CUTOFF} SELECT case_id, ts, l_linenumber, l_partkey, l_suppkey, "StartTime", part
FROM e WHERE part IS NOT NULL""",
)
def cutoff_split(spark, folder):
    train, test = _both_sides(spark, folder)
    keep = ["case_id", "ts", "l_linenumber", "l_partkey", "l_suppkey", "StartTime"]
    return (
        train.df.select(*keep, F.lit("train").alias("part"))
        .unionByName(test.df.select(*keep, F.lit("test").alias("part")))
    )


@query(
    "split_violations",
    f"""{_CUTOFF}
SELECT max(ts) FILTER (WHERE part = 'train') >= min(ts) FILTER (WHERE part = 'test') AS order_broken,
       max(ts) FILTER (WHERE part = 'train') >= min("StartTime") FILTER (WHERE part = 'test')
         AS overlap,
       (SELECT count(*) FROM (SELECT case_id FROM e WHERE part = 'train'
                              INTERSECT SELECT case_id FROM e WHERE part = 'test')) AS shared_cases
FROM e""",
)
def split_violations(spark, folder):
    train, test = _both_sides(spark, folder)
    return splits.split_violations(train.df, test.df, train.spec)


@query(
    "split_violations_found",
    f"""WITH {ORDER_LOG},
c AS (SELECT *, min(ts) OVER (PARTITION BY case_id) AS s,
             CASE WHEN year(ts) <= 1998 THEN 'train' ELSE 'test' END AS part FROM order_log)
SELECT max(ts) FILTER (WHERE part = 'train') >= min(ts) FILTER (WHERE part = 'test') AS order_broken,
       max(ts) FILTER (WHERE part = 'train') >= min(s) FILTER (WHERE part = 'test') AS overlap,
       (SELECT count(*) FROM (SELECT case_id FROM c WHERE part = 'train'
                              INTERSECT SELECT case_id FROM c WHERE part = 'test')) AS shared_cases
FROM c""",
)
def split_violations_found(spark, folder):
    """A split by event year, which tears cases apart."""
    log = features.case_start(samples.order_log(spark, folder))
    early = F.year("ts") <= 1998
    return splits.split_violations(log.filter(early).df, log.filter(~early).df, log.spec)


@query("random_split")
def random_split(spark, folder):
    cases = samples.order_cases(spark, folder).select("case_id")
    train, held_out = splits.random_split(cases, samples.ORDER_SPEC)
    return train.withColumn("part", F.lit("train")).unionByName(
        held_out.withColumn("part", F.lit("validation"))
    )


@query(
    "random_split_parts",
    """SELECT count(*) AS n_cases, CAST(0 AS BIGINT) AS in_both, TRUE AS near_share
FROM orders""",
)
def random_split_parts(spark, folder):
    """All cases are in one part, and the parts have about their shares."""
    parts = random_split(spark, folder).groupBy("case_id").agg(
        F.count_distinct("part").alias("parts"), F.max("part").alias("part")
    )
    share = F.avg((F.col("part") == "train").cast("double"))
    return parts.agg(
        F.count("*").alias("n_cases"),
        F.count(F.when(F.col("parts") > 1, 1)).alias("in_both"),
        (F.abs(share - 0.8) < 0.05).alias("near_share"),
    )


@query("fold_assign")
def fold_assign(spark, folder):
    log = labelled_orders(spark, folder)
    cases = log.df.groupBy("case_id").agg(F.max("y").alias("y"))
    return splits.stratified_folds(cases, log.spec, "y", 5)


@query(
    "fold_sizes",
    f"""WITH {ORDER_LOG}, {labelled("order_log", "NO", "RF")},
c AS (SELECT case_id, max(y) AS y FROM lab GROUP BY 1),
f AS (SELECT y, CAST((row_number() OVER (ORDER BY y, case_id) - 1) % 5 AS INTEGER) AS fold FROM c)
SELECT y, fold, count(*) AS n FROM f GROUP BY 1, 2""",
)
def fold_sizes(spark, folder):
    """How many cases of each label a fold has: fixed, whatever the random order."""
    return fold_assign(spark, folder).groupBy("y", "fold").agg(F.count("*").alias("n"))
