"""Queries: quality checks, joins, windows, features, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage
from weekloom.functions import calendar as C
from weekloom.functions import rules as R
from weekloom.operators import features as X
from weekloom.operators import folds as D
from weekloom.operators import joins as J
from weekloom.operators import ledger as L
from weekloom.operators import metrics as M
from weekloom.operators import quality as Q
from weekloom.operators import thresholds as H
from weekloom.plans import tables as V
from weekloom.plans.queries_rollup import area_daily, area_weekly
from weekloom.plans.tables import G, doubles, query

WEEK = "week_start_date"
KEY = [*G, WEEK]


# --- quality ---------------------------------------------------------------------------

@query(
    "dq_required_columns",
    """
SELECT 'o_orderkey' AS column_name, TRUE AS present, count(o_orderkey) AS value_count FROM orders
UNION ALL SELECT 'o_orderdate', TRUE, count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', TRUE, count(o_orderpriority) FROM orders
UNION ALL SELECT 'hospitalized_cases', FALSE, 0""",
)
def _(spark, sf):
    return Q.column_presence(
        V.table(spark, sf, "orders"), ["o_orderkey", "o_orderdate", "o_orderpriority", "hospitalized_cases"]
    )


@query(
    "dq_unique_key",
    """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf):
    return Q.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_nonnegative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def _(spark, sf):
    return Q.negative_rows(V.table(spark, sf, "customer"), ["c_acctbal", "c_custkey"]).select("c_custkey", "c_acctbal")


@query(
    "dq_join_cardinality",
    """
SELECT count(*) FILTER (WHERE l > 1) AS left_repeated_keys, count(*) FILTER (WHERE r > 1) AS right_repeated_keys,
 count(*) FILTER (WHERE l IS NULL) AS right_only_keys, count(*) FILTER (WHERE r IS NULL) AS left_only_keys,
 CASE WHEN count(*) FILTER (WHERE l > 1) > 0 THEN 'many' ELSE 'one' END || '_to_' ||
 CASE WHEN count(*) FILTER (WHERE r > 1) > 0 THEN 'many' ELSE 'one' END AS cardinality
FROM (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY ALL)
FULL OUTER JOIN (SELECT c_custkey AS k, count(*) AS r FROM customer GROUP BY ALL) USING (k)""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return Q.join_cardinality(o, c, ["k"])


@query(
    "dq_row_loss_guard",
    """
SELECT geography, CAST(sum(o) AS BIGINT) AS old_rows, CAST(sum(n) AS BIGINT) AS new_rows,
  sum(o) = 0 OR sum(n) >= 0.9::DOUBLE * sum(o) AS accepted
FROM (SELECT geography, 1 AS o, 0 AS n FROM v_weekly UNION ALL SELECT geography, 0, 1 FROM v_old) GROUP BY ALL""",
    ("v_weekly", "v_old"),
)
def _(spark, sf):
    return Q.row_loss(V.weekly(spark, sf), V.old_weekly(spark, sf), G)


@query(
    "dq_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM v_spatial" for c in ("date", *S.DAILY_WEATHER)
    ),
    ("v_spatial",),
)
def _(spark, sf):
    return Q.null_counts(area_daily(spark, sf), ["date", *S.DAILY_WEATHER])


@query(
    "dq_completeness_hist",
    "SELECT weather_days_available, count(*) AS row_count FROM v_weather GROUP BY ALL",
    ("v_weather",),
)
def _(spark, sf):
    return Q.value_histogram(area_weekly(spark, sf), ["weather_days_available"])


@query(
    "dq_range_compare",
    """
SELECT 'orders' AS source, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders
UNION ALL SELECT 'lineitem', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
UNION ALL SELECT 'events', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""",
)
def _(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    return Q.date_ranges(
        {"orders": (t("orders"), "o_orderdate"), "lineitem": (t("lineitem"), "l_shipdate"), "events": (t("events"), "ts")}
    )


_DESC = "\nUNION ALL\n".join(
    f"""SELECT l_returnflag, '{c}' AS column_name, count({c}) AS value_count, round(avg({c}), 6) AS mean,
 round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
 round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max
FROM lineitem GROUP BY l_returnflag"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query("profile_describe", _DESC)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return doubles(Q.describe(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"]))


@query(
    "outlier_count",
    """
SELECT event_type, round(upper_limit, 6) AS upper_limit, count(*) FILTER (WHERE value > upper_limit) AS outlier_count
FROM events JOIN (SELECT event_type, avg(value) + 2 * stddev_samp(value) AS upper_limit FROM events GROUP BY ALL) USING (event_type)
GROUP BY event_type, upper_limit""",
)
def _(spark, sf):
    return doubles(Q.outlier_counts(V.table(spark, sf, "events"), "value", ["event_type"]))


@query(
    "dq_enum_check",
    """
SELECT coalesce(s.o_orderstatus, w.o_orderstatus) AS o_orderstatus, coalesce(row_count, 0) AS row_count,
   w.o_orderstatus IS NOT NULL AS expected
FROM (SELECT o_orderstatus, count(*) AS row_count FROM orders GROUP BY ALL) s
FULL OUTER JOIN (VALUES ('F'), ('O'), ('X')) AS w(o_orderstatus) ON s.o_orderstatus = w.o_orderstatus
WHERE w.o_orderstatus IS NULL OR row_count IS NULL""",
)
def _(spark, sf):
    return Q.unexpected_values(V.table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "X"])


@query(
    "dq_probability_range",
    "SELECT event_id, round(value / 100, 6) AS probability FROM events WHERE value / 100 > 1 OR value / 100 < 0",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("probability"))
    return doubles(Q.out_of_unit_range(e, "probability"))


# --- joins -----------------------------------------------------------------------------

@query(
    "join_inner_1to1",
    """
SELECT w.geography, w.week_start_date, w.total_cases, o.total_cases AS earlier_cases
FROM v_weekly w JOIN v_old o USING (geography, week_start_date)""",
    ("v_weekly", "v_old"),
)
def _(spark, sf):
    features = V.weekly(spark, sf).select(*KEY, "total_cases")
    labels = V.old_weekly(spark, sf).select(*KEY, F.col("total_cases").alias("earlier_cases"))
    return J.features_with_labels(features, labels, KEY, "earlier_cases")


@query(
    "join_left_1m",
    """
SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey""",
)
def _(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return J.fan_out(c, o, ["c_custkey"])


@query(
    "delay_cross",
    """
SELECT t.geography, t.week_start_date, CAST(d.k AS INTEGER) AS delay_weeks, CAST(t.week_start_date - CAST(7 * d.k AS INTEGER) AS DATE) AS anchor_week,
 a.total_cases AS anchor_cases
FROM v_sparse t CROSS JOIN generate_series(4, 12) AS d(k)
LEFT JOIN v_sparse a ON a.geography = t.geography AND a.week_start_date = t.week_start_date - CAST(7 * d.k AS INTEGER)""",
    ("v_sparse",),
)
def _(spark, sf):
    s = V.sparse(spark, sf).select(*KEY, "total_cases")
    targets = X.delay_cross(s.select(*KEY))
    anchors = s.select(*G, F.col(WEEK).alias("anchor_week"), F.col("total_cases").alias("anchor_cases"))
    return targets.join(anchors, [*G, "anchor_week"], "left")


# Targets of the live operators: every fourth week after the sparse series' weeks.
_TARGETS = """
 (SELECT geography, CAST(week_start_date + 35 AS DATE) AS week_start_date FROM v_sparse)"""


def live_targets(cases):
    return cases.select(*G, F.date_add(WEEK, 35).alias(WEEK))


@query(
    "asof_report",
    f"""
SELECT geography, week_start_date, anchor AS case_report_anchor_week, CAST(week_start_date - anchor AS DOUBLE) / 7 AS report_age_weeks
FROM (SELECT t.geography, t.week_start_date, max(h.week_start_date) AS anchor
 FROM {_TARGETS} t JOIN v_sparse h ON h.geography = t.geography AND h.week_start_date < t.week_start_date GROUP BY ALL)
WHERE (week_start_date - anchor) % 7 = 0 AND (week_start_date - anchor) / 7 BETWEEN 2 AND 12""",
    ("v_sparse",),
)
def _(spark, sf):
    s = V.sparse(spark, sf)
    return X.asof_report(s, live_targets(s), G, 2, 12)


@query(
    "override_join",
    """
SELECT f.geography, f.week_start_date, f.actual_cases, o.total_cases + 0.5::DOUBLE AS cases_lag_1
FROM v_forecast f JOIN v_old o ON o.geography = f.geography AND o.week_start_date = f.week_start_date - 7""",
    ("v_forecast", "v_old"),
)
def _(spark, sf):
    f = V.forecasts(spark, sf).select(*KEY, "actual_cases", "cases_lag_1")
    o = V.old_weekly(spark, sf).select(
        *G, F.date_add(WEEK, 7).alias(WEEK), (F.col("total_cases") + 0.5).alias("cases_lag_1")
    )
    return X.apply_overrides(f, o, KEY, ["cases_lag_1", "absent_feature"])


@query(
    "diff_join",
    """
SELECT w.geography, w.week_start_date, o.total_cases AS old_total_cases, w.total_cases AS new_total_cases,
 o.hospitalized_cases AS old_hospitalized_cases, w.hospitalized_cases AS new_hospitalized_cases,
 CASE WHEN o.geography IS NULL THEN 'new' ELSE 'revision' END AS change_type
FROM v_weekly w LEFT JOIN v_old o USING (geography, week_start_date)
WHERE o.geography IS NULL OR o.total_cases <> w.total_cases OR o.hospitalized_cases <> w.hospitalized_cases""",
    ("v_weekly", "v_old"),
)
def _(spark, sf):
    return L.revision_events(V.old_weekly(spark, sf), V.weekly(spark, sf), KEY)


@query(
    "truth_join",
    """
SELECT l.geography, l.as_of_date, l.week_start_date, l.lead_weeks, w.total_cases AS actual_cases
FROM v_ledger l LEFT JOIN v_weekly w USING (geography, week_start_date)""",
    ("v_ledger",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    truth = w.select(*KEY, F.col("total_cases").alias("actual_cases"))
    return J.lookup(V.ledger(spark, sf, w).select(*KEY, "as_of_date", "lead_weeks"), truth, KEY)


# --- windows and features --------------------------------------------------------------

_feat = list(S.WEEKLY_WEATHER)
_W = "PARTITION BY geography ORDER BY week_start_date"


def _roll_sql(c, n):
    kind = {"avg": "avg", "sum": "sum", "max": "max"}[S.rolling_kind(c)]
    f = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count({c}) {f} = {n} THEN {kind}({c}) {f} END, 6) AS {c}_rolling_{n}"


@query(
    "weather_lags",
    "SELECT geography, week_start_date, "
    + ", ".join(f"round(lag({c}, {k}) OVER ({_W}), 6) AS {c}_lag_{k}" for c in _feat for k in S.WEATHER_LAGS)
    + " FROM v_weather",
    ("v_weather",),
)
def _(spark, sf):
    f = X.weather_features(area_weekly(spark, sf), G, _feat)
    return doubles(f.select(*KEY, *[f"{c}_lag_{k}" for c in _feat for k in S.WEATHER_LAGS]))


@query(
    "weather_rolling",
    "SELECT geography, week_start_date, " + ", ".join(_roll_sql(c, n) for c in _feat for n in S.ROLLING_WEEKS) + " FROM v_weather",
    ("v_weather",),
)
def _(spark, sf):
    f = X.weather_features(area_weekly(spark, sf), G, _feat)
    return doubles(f.select(*KEY, *[f"{c}_rolling_{n}" for c in _feat for n in S.ROLLING_WEEKS]))


_OPER = """
SELECT geography, week_start_date, cases_lag_1, cases_lag_2, cases_lag_4, round(cases_mean_4, 6) AS cases_mean_4,
 round(cases_mean_8, 6) AS cases_mean_8, cases_lag_1 - cases_lag_2 AS cases_change_1 FROM v_lags"""


@query("case_lags_operational", _OPER, ("v_lags",))
def _(spark, sf):
    return doubles(X.case_lags(V.weekly(spark, sf), G).select(*KEY, *S.CASE_FEATURES))


@query(
    "case_lags_calendar",
    """
SELECT s.geography, s.week_start_date, CAST(a.total_cases AS DOUBLE) AS cases_lag_1, CAST(b.total_cases AS DOUBLE) AS cases_lag_2,
 CAST(c.total_cases AS DOUBLE) AS cases_lag_4,
 (SELECT CASE WHEN count(*) = 4 THEN round(avg(p.total_cases), 6) END FROM v_sparse p
  WHERE p.geography = s.geography AND p.week_start_date BETWEEN s.week_start_date - 28 AND s.week_start_date - 7) AS cases_mean_4,
 (SELECT CASE WHEN count(*) = 8 THEN round(avg(p.total_cases), 6) END FROM v_sparse p
  WHERE p.geography = s.geography AND p.week_start_date BETWEEN s.week_start_date - 56 AND s.week_start_date - 7) AS cases_mean_8,
 CAST(a.total_cases - b.total_cases AS DOUBLE) AS cases_change_1
FROM v_sparse s LEFT JOIN v_sparse a ON a.geography = s.geography AND a.week_start_date = s.week_start_date - 7
LEFT JOIN v_sparse b ON b.geography = s.geography AND b.week_start_date = s.week_start_date - 14
LEFT JOIN v_sparse c ON c.geography = s.geography AND c.week_start_date = s.week_start_date - 28""",
    ("v_sparse",),
)
def _(spark, sf):
    return doubles(X.case_lags(V.sparse(spark, sf), G, calendar=True).select(*KEY, *S.CASE_FEATURES))


@query(
    "case_lags_historical",
    f"""
SELECT geography, week_start_date, CAST(lag(total_cases, 1) OVER w AS DOUBLE) AS cases_lag_1,
 CAST(lag(total_cases, 2) OVER w AS DOUBLE) AS cases_lag_2, CAST(lag(total_cases, 4) OVER w AS DOUBLE) AS cases_lag_4,
 CAST(lag(total_cases, 52) OVER w AS DOUBLE) AS cases_lag_52,
 round(avg(total_cases) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS cases_mean_4,
 round(avg(total_cases) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS cases_mean_8,
 CAST(lag(total_cases, 1) OVER w - lag(total_cases, 2) OVER w AS DOUBLE) AS cases_change_1
FROM v_weekly WINDOW w AS ({_W})""",
    ("v_weekly",),
)
def _(spark, sf):
    f = X.case_lags(V.weekly(spark, sf), G, family="historical")
    return doubles(f.select(*KEY, *S.CASE_FEATURES, "cases_lag_52"))


@query(
    "hospital_lags",
    f"""
SELECT geography, week_start_date, CAST(lag(hospitalized_cases, 1) OVER ({_W}) AS DOUBLE) AS hospitalized_lag_1,
 CAST(lag(hospitalized_cases, 2) OVER ({_W}) AS DOUBLE) AS hospitalized_lag_2,
 CASE WHEN n = 4 THEN round(h / 4.0, 6) END AS hospitalized_mean_4,
 CASE WHEN n = 4 THEN CASE WHEN c <> 0 THEN round(h / CAST(c AS DOUBLE), 6) WHEN h = 0 THEN 0 END END AS hospitalization_rate_mean_4
FROM (SELECT *, count(*) OVER f AS n, sum(hospitalized_cases) OVER f AS h, sum(total_cases) OVER f AS c FROM v_sparse
  WINDOW f AS ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""",
    ("v_sparse",),
)
def _(spark, sf):
    return doubles(X.hospital_lags(V.sparse(spark, sf), G).select(*KEY, *S.HOSPITAL_FEATURES))


@query(
    "delayed_features",
    f"""
WITH a AS (SELECT *, row_number() OVER ({_W}) AS ord, lag(total_cases, 1) OVER ({_W}) AS l1, lag(total_cases, 2) OVER ({_W}) AS l2,
  lag(total_cases, 4) OVER ({_W}) AS l4, count(*) OVER f4 AS n4, count(*) OVER f8 AS n8, sum(total_cases) OVER f4 AS c4,
  sum(total_cases) OVER f8 AS c8, sum(hospitalized_cases) OVER f4 AS h4 FROM v_weekly
  WINDOW f4 AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), f8 AS ({_W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT t.geography, t.week_start_date, CAST(d.k AS DOUBLE) AS report_age_weeks,
 CAST(a.total_cases AS DOUBLE) AS delayed_cases_latest, CAST(a.l1 AS DOUBLE) AS delayed_cases_lag_1,
 CAST(a.l2 AS DOUBLE) AS delayed_cases_lag_2, CAST(a.l4 AS DOUBLE) AS delayed_cases_lag_4,
 CASE WHEN a.n4 = 4 THEN round(a.c4 / 4.0, 6) END AS delayed_cases_mean_4,
 CASE WHEN a.n8 = 8 THEN round(a.c8 / 8.0, 6) END AS delayed_cases_mean_8,
 CAST(a.total_cases - a.l1 AS DOUBLE) AS delayed_cases_change_1, CAST(a.hospitalized_cases AS DOUBLE) AS delayed_hospitalized_latest,
 CASE WHEN a.n4 = 4 THEN round(a.h4 / 4.0, 6) END AS delayed_hospitalized_mean_4,
 CASE WHEN a.n4 = 4 THEN CASE WHEN a.c4 <> 0 THEN round(a.h4 / CAST(a.c4 AS DOUBLE), 6) WHEN a.h4 = 0 THEN 0 END END
   AS delayed_hospitalization_rate_mean_4
FROM a t CROSS JOIN generate_series(4, 12) AS d(k) LEFT JOIN a ON a.geography = t.geography AND a.ord = t.ord - d.k""",
    ("v_weekly",),
)
def _(spark, sf):
    return doubles(X.delayed_features(V.weekly(spark, sf), G).select(*KEY, *S.DELAYED_FEATURES))


@query(
    "delayed_features_calendar",
    """
WITH x AS (SELECT t.geography, t.week_start_date, d.k, g.j, h.total_cases AS c, h.hospitalized_cases AS p
  FROM v_sparse t CROSS JOIN generate_series(4, 12) AS d(k) CROSS JOIN generate_series(0, 7) AS g(j)
  LEFT JOIN v_sparse h ON h.geography = t.geography AND h.week_start_date = t.week_start_date - CAST(7 * (d.k + g.j) AS INTEGER)),
 y AS (SELECT geography, week_start_date, k, max(c) FILTER (WHERE j = 0) AS c0, max(c) FILTER (WHERE j = 1) AS c1, max(c) FILTER (WHERE j = 2) AS c2,
  max(c) FILTER (WHERE j = 4) AS c4, count(c) FILTER (WHERE j < 4) AS n4, count(c) AS n8, sum(c) FILTER (WHERE j < 4) AS s4, sum(c) AS s8,
  max(p) FILTER (WHERE j = 0) AS p0, sum(p) FILTER (WHERE j < 4) AS h4 FROM x GROUP BY ALL)
SELECT geography, week_start_date, CAST(k AS DOUBLE) AS report_age_weeks, CAST(c0 AS DOUBLE) AS delayed_cases_latest,
 CASE WHEN c0 IS NOT NULL THEN CAST(c1 AS DOUBLE) END AS delayed_cases_lag_1, CASE WHEN c0 IS NOT NULL THEN CAST(c2 AS DOUBLE) END AS delayed_cases_lag_2,
 CASE WHEN c0 IS NOT NULL THEN CAST(c4 AS DOUBLE) END AS delayed_cases_lag_4, CASE WHEN n4 = 4 THEN round(s4 / 4.0::DOUBLE, 6) END AS delayed_cases_mean_4,
 CASE WHEN n8 = 8 THEN round(s8 / 8.0::DOUBLE, 6) END AS delayed_cases_mean_8, CAST(c0 - c1 AS DOUBLE) AS delayed_cases_change_1,
 CAST(p0 AS DOUBLE) AS delayed_hospitalized_latest, CASE WHEN n4 = 4 THEN round(h4 / 4.0::DOUBLE, 6) END AS delayed_hospitalized_mean_4,
 CASE WHEN n4 = 4 THEN CASE WHEN s4 <> 0 THEN round(h4 / CAST(s4 AS DOUBLE), 6) WHEN h4 = 0 THEN 0 END END AS delayed_hospitalization_rate_mean_4
FROM y""",
    ("v_sparse",),
)
def _(spark, sf):
    f = X.delayed_features(V.sparse(spark, sf), G, calendar=True)
    return doubles(f.select(*KEY, *S.DELAYED_FEATURES))


@query(
    "live_exact_features",
    f"""
WITH t AS (SELECT DISTINCT * FROM {_TARGETS}),
 p AS (SELECT t.geography, t.week_start_date, CAST((t.week_start_date - h.week_start_date) / 7 AS INTEGER) AS k,
        h.total_cases AS c, h.hospitalized_cases AS hosp
       FROM t JOIN v_sparse h ON h.geography = t.geography AND h.week_start_date BETWEEN t.week_start_date - 56 AND t.week_start_date - 7)
SELECT geography, week_start_date, CAST(max(c) FILTER (WHERE k = 1) AS DOUBLE) AS cases_lag_1,
 CAST(max(c) FILTER (WHERE k = 2) AS DOUBLE) AS cases_lag_2, CAST(max(c) FILTER (WHERE k = 4) AS DOUBLE) AS cases_lag_4,
 round(avg(c) FILTER (WHERE k <= 4), 6) AS cases_mean_4, round(avg(c), 6) AS cases_mean_8,
 CAST(max(c) FILTER (WHERE k = 1) - max(c) FILTER (WHERE k = 2) AS DOUBLE) AS cases_change_1,
 CAST(max(hosp) FILTER (WHERE k = 1) AS DOUBLE) AS hospitalized_lag_1, CAST(max(hosp) FILTER (WHERE k = 2) AS DOUBLE) AS hospitalized_lag_2,
 round(avg(hosp) FILTER (WHERE k <= 4), 6) AS hospitalized_mean_4,
 CASE WHEN sum(c) FILTER (WHERE k <= 4) = 0 THEN 0 ELSE
  round(sum(hosp) FILTER (WHERE k <= 4) / CAST(sum(c) FILTER (WHERE k <= 4) AS DOUBLE), 6) END AS hospitalization_rate_mean_4
FROM p GROUP BY ALL HAVING count(*) = 8""",
    ("v_sparse",),
)
def _(spark, sf):
    s = V.sparse(spark, sf)
    return doubles(X.live_exact_features(s, live_targets(s), G).select(*KEY, *S.EXACT_FEATURES))


@query(
    "live_delayed_features",
    f"""
WITH t AS (SELECT t.geography, t.week_start_date, max(h.week_start_date) AS anchor
   FROM {_TARGETS} t JOIN v_sparse h ON h.geography = t.geography AND h.week_start_date < t.week_start_date GROUP BY ALL),
 p AS (SELECT t.*, CAST((t.anchor - h.week_start_date) / 7 AS INTEGER) AS k, h.total_cases AS c, h.hospitalized_cases AS hosp
   FROM t JOIN v_sparse h ON h.geography = t.geography AND h.week_start_date BETWEEN t.anchor - 49 AND t.anchor
   WHERE (t.week_start_date - t.anchor) / 7 BETWEEN 1 AND 12)
SELECT geography, week_start_date, anchor AS case_report_anchor_week, CAST(max(c) FILTER (WHERE k = 0) AS DOUBLE) AS delayed_cases_latest,
 CAST(max(c) FILTER (WHERE k = 1) AS DOUBLE) AS delayed_cases_lag_1, CAST(max(c) FILTER (WHERE k = 2) AS DOUBLE) AS delayed_cases_lag_2,
 CAST(max(c) FILTER (WHERE k = 4) AS DOUBLE) AS delayed_cases_lag_4, round(avg(c) FILTER (WHERE k < 4), 6) AS delayed_cases_mean_4,
 round(avg(c), 6) AS delayed_cases_mean_8,
 CAST(max(c) FILTER (WHERE k = 0) - max(c) FILTER (WHERE k = 1) AS DOUBLE) AS delayed_cases_change_1,
 CAST(max(hosp) FILTER (WHERE k = 0) AS DOUBLE) AS delayed_hospitalized_latest,
 round(avg(hosp) FILTER (WHERE k < 4), 6) AS delayed_hospitalized_mean_4,
 CASE WHEN sum(c) FILTER (WHERE k < 4) = 0 THEN 0 ELSE
  round(sum(hosp) FILTER (WHERE k < 4) / CAST(sum(c) FILTER (WHERE k < 4) AS DOUBLE), 6) END AS delayed_hospitalization_rate_mean_4,
 CAST(week_start_date - anchor AS DOUBLE) / 7 AS report_age_weeks
FROM p GROUP BY geography, week_start_date, anchor HAVING count(*) = 8""",
    ("v_sparse",),
)
def _(spark, sf):
    s = V.sparse(spark, sf)
    return doubles(X.live_delayed_features(s, live_targets(s), G, 1, 12))


@query(
    "route_select",
    f"""
WITH t AS (SELECT DISTINCT * FROM {_TARGETS}),
 x AS (SELECT t.geography, t.week_start_date FROM t JOIN v_sparse h ON h.geography = t.geography
   AND h.week_start_date BETWEEN t.week_start_date - 56 AND t.week_start_date - 7 GROUP BY ALL HAVING count(*) = 8),
 a AS (SELECT t.geography, t.week_start_date, max(h.week_start_date) AS anchor
   FROM t JOIN v_sparse h ON h.geography = t.geography AND h.week_start_date < t.week_start_date GROUP BY ALL),
 d AS (SELECT a.geography, a.week_start_date, a.anchor FROM a JOIN v_sparse h ON h.geography = a.geography
   AND h.week_start_date BETWEEN a.anchor - 49 AND a.anchor WHERE (a.week_start_date - a.anchor) / 7 BETWEEN 2 AND 12
   GROUP BY ALL HAVING count(*) = 8)
SELECT t.geography, t.week_start_date,
 CASE WHEN x.geography IS NOT NULL THEN 'weather_plus_recent_cases' WHEN d.geography IS NOT NULL THEN 'weather_plus_delayed_cases'
   ELSE 'weather_only' END AS model_variant,
 CASE WHEN x.geography IS NOT NULL THEN 'stronger_exact_recent_cases' WHEN d.geography IS NOT NULL THEN 'moderate_delayed_case_history'
   ELSE 'limited_no_usable_case_history' END AS case_forecast_reliability,
 CASE WHEN x.geography IS NOT NULL THEN CAST(t.week_start_date - 7 AS DATE) ELSE d.anchor END AS case_report_anchor_week,
 CASE WHEN x.geography IS NOT NULL THEN 1.0::DOUBLE ELSE CAST(t.week_start_date - d.anchor AS DOUBLE) / 7 END AS case_report_age_weeks
FROM t LEFT JOIN x USING (geography, week_start_date) LEFT JOIN d USING (geography, week_start_date)""",
    ("v_sparse",),
)
def _(spark, sf):
    from weekloom.operators.routing import route_targets

    s = V.sparse(spark, sf)
    targets = live_targets(s).distinct()
    routed = route_targets(targets, s, G, 2, 12)
    return routed.select(
        *KEY, "model_variant", "case_forecast_reliability", "case_report_anchor_week", "case_report_age_weeks"
    )


_fill = list(S.WEEKLY_WEATHER)


@query(
    "ffill_median",
    f"""
WITH r AS (SELECT *, CAST(isoyear(week_start_date) AS INTEGER) AS year FROM v_weather),
 m AS (SELECT geography, {', '.join(f'median({c}) AS m_{c}' for c in _fill)} FROM r WHERE year < 2000 GROUP BY ALL)
SELECT r.geography, r.week_start_date,
 {', '.join(f'round(coalesce(last_value({c} IGNORE NULLS) OVER w, m_{c}), 6) AS {c}' for c in _fill)}
FROM r JOIN m USING (geography)
WINDOW w AS (PARTITION BY r.geography ORDER BY week_start_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ("v_weather",),
)
def _(spark, sf):
    w = area_weekly(spark, sf).select(*KEY, *_fill)
    medians = M.wide_medians(w.filter(C.iso_year(WEEK) < 2000), G, _fill)
    return doubles(X.forward_fill(w, G, _fill, medians).select(*KEY, *_fill))


@query(
    "column_medians",
    "\nUNION ALL\n".join(
        f"SELECT l_returnflag, '{c}' AS column_name, round(median({c}), 6) AS median FROM lineitem GROUP BY ALL"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return doubles(M.column_medians(li, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"]))


_LAGCOLS = list(S.WEEKLY_WEATHER)
#: Lag ranges that the programs search, all answered by one table of moments.
_LAG_RANGES = (8, 12, 20)


def _series_with_weather(spark, sf):
    """Weekly cases of all areas beside the weather of their status area."""
    w = area_weekly(spark, sf)
    cases = V.weekly(spark, sf).groupBy(WEEK).agg(F.sum("total_cases").alias("total_cases"))
    return cases.join(w, WEEK)


_LAGVIEW = f"""
 j AS (SELECT w.*, c.total_cases, row_number() OVER (PARTITION BY w.geography ORDER BY w.week_start_date) AS ord FROM v_weather w
       JOIN (SELECT week_start_date, sum(total_cases) AS total_cases FROM v_weekly GROUP BY ALL) c USING (week_start_date)),
 fields AS (""" + " UNION ALL ".join(f"SELECT geography, ord, total_cases, '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM j" for c in _LAGCOLS) + f"""),
 q AS (SELECT a.geography, a.column_name, CAST(k AS INTEGER) AS lag_weeks,
    round(CASE WHEN var_pop(b.x) > 1e-20 AND NOT isnan(corr(a.total_cases, b.x)) THEN corr(a.total_cases, b.x) END, 6) AS correlation,
    count(b.x) AS pairs
   FROM fields a, (SELECT unnest(range({max(_LAG_RANGES) + 1})) AS k)
   LEFT JOIN fields b ON b.geography = a.geography AND b.column_name = a.column_name AND b.ord = a.ord - k GROUP BY ALL),
 ranges AS (SELECT unnest({list(_LAG_RANGES)}) AS maximum_lag),
 b AS (SELECT CAST(maximum_lag AS INTEGER) AS maximum_lag, geography, column_name, lag_weeks AS best_lag, coalesce(abs(correlation), 0) AS best_abs_correlation
   FROM ranges JOIN q ON lag_weeks <= maximum_lag
   QUALIFY row_number() OVER (PARTITION BY maximum_lag, geography, column_name ORDER BY coalesce(abs(correlation), 0) DESC, lag_weeks) = 1)"""


def _lag_table(spark, sf):
    rows = _series_with_weather(spark, sf)
    return rows, cut_lineage(doubles(M.lag_corr(rows, G, "total_cases", _LAGCOLS, max(_LAG_RANGES))))


@query("lag_corr", f"WITH {_LAGVIEW} SELECT geography, column_name, lag_weeks, correlation, pairs FROM q", ("v_weather", "v_weekly"))
def _(spark, sf):
    return _lag_table(spark, sf)[1]


@query(
    "best_lag",
    f"WITH {_LAGVIEW} SELECT maximum_lag, geography, column_name, best_lag, best_abs_correlation FROM b",
    ("v_weather", "v_weekly"),
)
def _(spark, sf):
    """The best lag of each search range, all from one table of moments."""
    _, found = _lag_table(spark, sf)
    return J.union_parts([M.best_lag(found, G, maximum_lag=k).withColumn("maximum_lag", F.lit(k)) for k in _LAG_RANGES])


@query(
    "selected_lag_features",
    f"""WITH {_LAGVIEW}, c AS (SELECT geography, column_name, best_lag FROM b WHERE maximum_lag = 12),
 p AS (SELECT f.geography, f.ord + c.best_lag AS ord, column_name, f.x, avg(f.x) OVER (PARTITION BY f.geography, column_name ORDER BY f.ord
   ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM fields f JOIN c USING (geography, column_name))
SELECT t.geography, t.week_start_date,
 {', '.join(f"round(max(CASE WHEN column_name = '{c}' THEN p.x END), 6) AS {c}_chosen_lag, round(max(CASE WHEN column_name = '{c}' THEN p.m END), 6) AS {c}_mean_4" for c in _LAGCOLS)}
FROM j t LEFT JOIN p ON p.geography = t.geography AND p.ord = t.ord GROUP BY ALL""",
    ("v_weather", "v_weekly"),
)
def _(spark, sf):
    rows, found = _lag_table(spark, sf)
    out = X.selected_lag_features(rows.select(*KEY, *_LAGCOLS), G, _LAGCOLS, M.best_lag(found, G, maximum_lag=12))
    return doubles(out.select(*KEY, *[f"{c}_{s}" for c in _LAGCOLS for s in ("chosen_lag", "mean_4")]))


@query(
    "corr_matrix",
    "\nUNION ALL\n".join(
        f"SELECT l_linestatus, '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS correlation FROM lineitem GROUP BY ALL"
        for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:]
    ),
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return doubles(M.pairwise_corr(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"]))


_issue = list(S.WEEKLY_WEATHER)


def _override_sql(c):
    kind = S.rolling_kind(c)
    out = [f"round(i.{c}, 6) AS {c}_lag_0"]
    out += [f"round(o.{c}_{k}, 6) AS {c}_lag_{k}" for k in (2, 4, 8)]
    for n in (4, 8):
        if kind == "max":
            e = f"greatest(o.{c}_m{n}, i.{c})"
        elif kind == "sum":
            e = f"o.{c}_s{n} + i.{c}"
        else:
            e = f"(o.{c}_s{n} + i.{c}) / {n}.0"
        out.append(f"CASE WHEN o.{c}_n{n} = {n - 1} AND i.{c} IS NOT NULL THEN round({e}, 6) END AS {c}_rolling_{n}")
    return ", ".join(out)


def _heads_sql(c):
    out = [f"lag({c}, {k}) OVER ({_W}) AS {c}_{k}" for k in (2, 4, 8)]
    for n in (4, 8):
        f = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING)"
        out += [f"sum({c}) {f} AS {c}_s{n}", f"max({c}) {f} AS {c}_m{n}", f"count({c}) {f} AS {c}_n{n}"]
    return ", ".join(out)


@query(
    "issue_time_overrides",
    f"""
WITH i AS (SELECT geography, week_start_date, {', '.join(f'{c} * 1.5::DOUBLE AS {c}' for c in _issue)} FROM v_weather
           WHERE weather_days_available = 7),
 o AS (SELECT geography, week_start_date, {', '.join(_heads_sql(c) for c in _issue)} FROM v_weather)
SELECT geography, week_start_date, {', '.join(_override_sql(c) for c in _issue)} FROM o JOIN i USING (geography, week_start_date)""",
    ("v_weather",),
)
def _(spark, sf):
    w = area_weekly(spark, sf)
    issued = w.filter("weather_days_available = 7").select(*KEY, *[(F.col(c) * 1.5).alias(c) for c in _issue])
    out = X.issue_time_overrides(w, issued, G, _issue)
    names = [n for n in S.weather_feature_names(_issue) if not n.startswith("week_")]
    return doubles(out.select(*KEY, *names))


@query(
    "class_balance_weights",
    """
SELECT geography, week_start_date, outbreak_label,
 round(CASE WHEN outbreak_label = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END, 6) AS weight
FROM v_labelled JOIN (SELECT geography, count(*) AS n, sum(outbreak_label) AS p FROM v_labelled GROUP BY ALL) USING (geography)""",
    ("v_labelled",),
)
def _(spark, sf):
    rows = V.labelled(spark, sf).select(*KEY, "outbreak_label")
    return doubles(M.class_weights(rows, G))


# --- set operations --------------------------------------------------------------------

@query(
    "union_tagged",
    """
SELECT geography, week_start_date, total_cases, CASE WHEN year < 2000 THEN 'train' ELSE 'validation' END AS partition FROM v_weekly""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf).select(*KEY, "total_cases", "year")
    parts = {"train": w.filter("year < 2000"), "validation": w.filter("year >= 2000")}
    return J.union_tagged(parts).drop("year")


@query(
    "union_parts",
    """
SELECT geography, week_start_date, total_cases, CAST(NULL AS INTEGER) AS year FROM v_sparse
UNION ALL SELECT geography, week_start_date, total_cases, year FROM v_weekly""",
    ("v_sparse", "v_weekly"),
)
def _(spark, sf):
    a = V.sparse(spark, sf).select(*KEY, "total_cases")
    b = V.weekly(spark, sf).select(*KEY, "total_cases", "year")
    return J.union_parts([a, b])


@query(
    "schema_evolve",
    """
SELECT geography, week_start_date, total_cases, CAST(NULL AS BIGINT) AS pcr_cases, CAST(NULL AS BIGINT) AS igm_cases,
 hospitalized_cases, CAST(NULL AS BOOLEAN) AS complete_week, CAST(NULL AS VARCHAR) AS source_file_id,
 CAST(NULL AS VARCHAR) AS source_publication_date, CAST(NULL AS VARCHAR) AS retrieved_at_utc, CAST(NULL AS VARCHAR) AS source_page
FROM v_weekly""",
    ("v_weekly",),
)
def _(spark, sf):
    return J.conform(V.weekly(spark, sf), S.CASE_TABLE)


@query(
    "snapshot_equal",
    """
WITH o AS (SELECT geography, week_start_date, total_cases, hospitalized_cases FROM v_old),
 w AS (SELECT geography, week_start_date, total_cases, hospitalized_cases FROM v_weekly)
SELECT *, 1::BIGINT AS extra_rows FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM w)
UNION ALL SELECT *, -1::BIGINT FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM o)""",
    ("v_old", "v_weekly"),
)
def _(spark, sf):
    cols = [*KEY, "total_cases", "hospitalized_cases"]
    return L.snapshot_difference(V.old_weekly(spark, sf).select(*cols), V.weekly(spark, sf).select(*cols))


@query(
    "expanding_splits",
    """
WITH y AS (SELECT geography, year, row_number() OVER (PARTITION BY geography ORDER BY year DESC) AS r FROM v_weekly GROUP BY geography, year HAVING count(*) >= 50)
SELECT w.geography, w.week_start_date, w.year, w.total_cases, y.year AS validation_year,
 CASE WHEN w.year < y.year THEN 'train' ELSE 'validation' END AS fold_role
FROM v_weekly w JOIN y ON y.geography = w.geography AND w.year <= y.year AND y.r <= 4
WHERE EXISTS (SELECT 1 FROM v_weekly e WHERE e.geography = y.geography AND e.year < y.year)""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf).select(*KEY, "year", "total_cases")
    return D.expanding_splits(w, G)


@query(
    "inner_splits",
    """
WITH y AS (SELECT geography, year, row_number() OVER (PARTITION BY geography ORDER BY year DESC) AS r,
   count(*) OVER (PARTITION BY geography) AS n FROM (SELECT DISTINCT geography, year FROM v_weekly))
SELECT w.geography, w.week_start_date, w.year, w.total_cases, y.year AS validation_year,
 CASE WHEN w.year < y.year THEN 'train' ELSE 'validation' END AS fold_role
FROM v_weekly w JOIN y ON y.geography = w.geography AND w.year <= y.year AND y.r <= least(3, y.n - 3)""",
    ("v_weekly",),
)
def _(spark, sf):
    return D.inner_splits(V.weekly(spark, sf).select(*KEY, "year", "total_cases"), G)
