"""Queries: series with calendars of their own, and the audit of issued weather runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage, stored_small
from weekloom.functions import calendar as C
from weekloom.operators import audit as A
from weekloom.operators import city as Y
from weekloom.operators import features as X
from weekloom.operators import metrics as M
from weekloom.plans import tables as V
from weekloom.plans.queries_rollup import area_daily, area_weekly
from weekloom.plans.tables import G, SQL_VIEWS, _NEEDS, doubles, query

WEEK = "week_start_date"

# Every order priority is a city: its digit d sets the start weekday (2 d mod 7), the week numbering (d - 3 weeks off) and
# the area whose weather it has.
_START = "CAST({day} - CAST((isodow({day}) - 1 - {s} + 7) % 7 AS INTEGER) AS DATE)"
SQL_VIEWS["v_city"] = """
  SELECT DISTINCT o_orderpriority AS geography, CAST(left(o_orderpriority, 1) AS INTEGER) AS digit,
    2 * CAST(left(o_orderpriority, 1) AS INTEGER) % 7 AS start_weekday, CAST(left(o_orderpriority, 1) AS INTEGER) - 3 AS week_offset,
    CASE WHEN CAST(left(o_orderpriority, 1) AS INTEGER) % 2 = 1 THEN 'F' ELSE 'O' END AS area FROM orders"""
SQL_VIEWS["v_city_cases"] = f"""
  SELECT geography, week_start_date, CAST(isoyear(week_start_date) AS INTEGER) AS year,
    CAST((weekofyear(week_start_date) + week_offset - 1 + 53) % 53 + 1 AS INTEGER) AS weekofyear, count(*) AS total_cases
  FROM (SELECT c.*, {_START.format(day="CAST(o_orderdate AS DATE)", s="c.start_weekday")} AS week_start_date
        FROM orders o JOIN v_city c ON c.geography = o.o_orderpriority)
  GROUP BY geography, week_start_date, week_offset"""
_full = " AND ".join(f"{c} IS NOT NULL" for c in S.DAILY_WEATHER)
SQL_VIEWS["v_city_days"] = f"""
  SELECT c.geography, {_START.format(day="s.date", s="c.start_weekday")} AS week_start_date, count(*) FILTER (WHERE {_full}) AS days
  FROM v_spatial s JOIN v_city c ON c.area = s.geography GROUP BY ALL"""
_NEEDS.update({"v_city_cases": ("v_city",), "v_city_days": ("v_city", "v_spatial")})


def cities(spark, sf):
    o = V.table(spark, sf, "orders")
    digit = F.substring("geography", 1, 1).cast("int")
    found = o.select(F.col("o_orderpriority").alias("geography")).distinct()
    return stored_small(found.select(
        *G, digit.alias("digit"), (2 * digit % 7).alias("start_weekday"), (digit - 3).alias("week_offset"),
        F.when(digit % 2 == 1, "F").otherwise("O").alias("area"),
    ))


def city_cases(spark, sf, known):
    """Weekly orders of every city on its own grid, numbered its own way."""
    o = V.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "geography").join(known, G)
    start = C.week_floor("o_orderdate", F.col("start_weekday"))
    counted = o.groupBy(*G, start.alias(WEEK), "week_offset").agg(F.count(F.lit(1)).alias("total_cases"))
    return cut_lineage(counted.select(*G, WEEK, C.iso_year(WEEK).alias("year"), C.epi_week(WEEK, "week_offset").alias("weekofyear"), "total_cases"))


def city_daily(spark, sf, known):
    area = area_daily(spark, sf).withColumnRenamed("geography", "area")
    return area.join(known.select(*G, "area"), "area")


@query("city_calendar", "SELECT geography, start_weekday, week_offset FROM v_city", ("v_city",))
def _(spark, sf):
    """Start weekday and week offset of every city, found from its rows alone."""
    return Y.city_calendar(city_cases(spark, sf, cities(spark, sf)), G)


@query(
    "score_weeks",
    """
WITH now AS (SELECT geography, max(week_start_date) + 3 AS as_of_date FROM v_city_days a
   WHERE days >= 7 AND week_start_date < DATE '2001-06-01'
     AND EXISTS (SELECT 1 FROM v_city_days b WHERE b.geography = a.geography AND b.week_start_date = a.week_start_date + 7 AND b.days >= 7)
   GROUP BY geography),
 t AS (SELECT c.geography, c.digit, n.as_of_date, CAST(k AS BIGINT) AS lead_weeks, CAST(n.as_of_date - 3 + CAST(7 * k AS INTEGER) AS DATE) AS week_start_date, c.week_offset
   FROM v_city c JOIN now n USING (geography), (VALUES (0), (1)) AS leads(k)),
 recent AS (SELECT w.* FROM v_city_cases w JOIN v_city c USING (geography) JOIN now n USING (geography)
   WHERE w.week_start_date + 6 < n.as_of_date - CASE WHEN digit <= 2 THEN 60 ELSE 0 END),
 exact AS (SELECT t.geography, t.week_start_date FROM t JOIN recent r ON r.geography = t.geography
   AND r.week_start_date BETWEEN t.week_start_date - 56 AND t.week_start_date - 7 GROUP BY ALL HAVING count(*) = 8),
 newest AS (SELECT geography, max(week_start_date) AS latest_case_week FROM recent GROUP BY ALL),
 numbered AS (SELECT t.*, CAST((weekofyear(week_start_date) + week_offset - 1 + 53) % 53 + 1 AS INTEGER) AS weekofyear FROM t),
 q AS (SELECT n.geography, n.week_start_date, quantile_cont(w.total_cases::DOUBLE, 0.75) AS q FROM numbered n JOIN v_city_cases w ON w.geography = n.geography
   AND least(abs(w.weekofyear - n.weekofyear), 53 - abs(w.weekofyear - n.weekofyear)) <= 2 GROUP BY ALL)
SELECT n.geography, n.as_of_date, n.week_start_date, n.weekofyear, n.lead_weeks, CASE WHEN lead_weeks = 0 THEN 'current_week' ELSE 'forecast_week' END AS time_scope,
 CASE WHEN e.geography IS NULL THEN 'weather_only' ELSE 'weather_plus_recent_cases' END AS model_variant, round(q.q, 6) AS historical_outbreak_threshold_cases,
 CAST(7 AS BIGINT) AS weather_days_available, w.latest_case_week, round((n.week_start_date - w.latest_case_week) / 7.0::DOUBLE, 6) AS case_data_age_weeks,
 TRUE AS probability_holds, TRUE AS alert_holds
FROM numbered n LEFT JOIN exact e USING (geography, week_start_date) LEFT JOIN newest w USING (geography) LEFT JOIN q USING (geography, week_start_date)""",
    ("v_city_cases", "v_city_days"),
)
def _(spark, sf):
    """This week and the next of every city, each on its own calendar, with detectors trained on its whole history."""
    known = cities(spark, sf)
    cases = city_cases(spark, sf, known)
    calendar = Y.city_calendar(cases, G)
    weekly = cut_lineage(Y.city_weeks(city_daily(spark, sf, known), calendar, G))
    # Gaps take the last value before them; what a week has of its own days still decides whether it may be scored.
    filled = cut_lineage(X.forward_fill(weekly, G, S.WEEKLY_WEATHER, M.wide_medians(weekly, G, S.WEEKLY_WEATHER)))
    detectors = Y.train_city_detectors(cases, filled, G)
    ahead = weekly.select(*G, F.date_sub(WEEK, 7).alias(WEEK), F.col("weather_days_available").alias("_next"))
    whole = weekly.join(ahead, [*G, WEEK]).where((F.col("weather_days_available") >= 7) & (F.col("_next") >= 7) & (F.col(WEEK) < "2001-06-01"))
    now = stored_small(whole.groupBy(*G).agg(F.date_add(F.max(WEEK), 3).alias("now")))
    targets = Y.city_targets(calendar.join(now, G), G, F.col("now"))
    delay = F.when(F.col("digit") <= 2, 60).otherwise(0)
    recent = cases.join(known.select(*G, "digit"), G).join(now, G).where(F.date_add(WEEK, 6) < F.date_sub("now", delay)).select(*cases.columns)
    rows = Y.score_city_weeks(detectors, cases, recent, filled, targets, G, "2001-07-01T00:00:00Z")
    p = F.col("outbreak_probability")
    return doubles(rows.select(
        *G, "as_of_date", WEEK, "weekofyear", "lead_weeks", "time_scope", "model_variant", "historical_outbreak_threshold_cases",
        "weather_days_available", "latest_case_week", "case_data_age_weeks", p.between(0.0, 1.0).alias("probability_holds"),
        (F.col("outbreak_alert") == (p >= F.col("alert_gate"))).alias("alert_holds"),
    ))


_RUNS = """
 runs AS (SELECT geography, week_start_date, CAST(week_start_date AS TIMESTAMP) - to_hours(CAST(h AS INTEGER)) AS issued_at_utc, rain_sum * (1 + h / 100.0::DOUBLE) AS rain_sum
   FROM v_weather, (VALUES (12), (24), (30), (200)) AS t(h)
   WHERE weather_days_available = 7 AND (CAST(weekofyear(week_start_date) AS INTEGER) + h) % 7 <> 0 AND CAST(weekofyear(week_start_date) AS INTEGER) % 13 <> 0)"""


def _issued(spark, sf):
    """Four runs a week, some of them lost: 12, 24, 30 and 200 hours before the week."""
    hours = F.explode(F.array(*[F.lit(h) for h in (12, 24, 30, 200)])).alias("h")
    week = C.iso_week(WEEK)
    kept = area_weekly(spark, sf).where("weather_days_available = 7").select("*", hours).where(((week + F.col("h")) % 7 != 0) & (week % 13 != 0))
    at = F.timestamp_add("HOUR", -F.col("h"), F.col(WEEK).cast("timestamp"))
    return kept.select(*G, WEEK, at.alias("issued_at_utc"), (F.col("rain_sum") * (1 + F.col("h") / 100.0)).alias("rain_sum"))


@query(
    "issued_runs",
    f"""WITH {_RUNS}
SELECT geography, week_start_date, strftime(issued_at_utc, '%Y-%m-%d %H:%M:%S') AS issued_at_utc, round(rain_sum, 6) AS rain_sum FROM runs
WHERE issued_at_utc <= CAST(week_start_date - 1 AS TIMESTAMP)
QUALIFY row_number() OVER (PARTITION BY geography, week_start_date ORDER BY issued_at_utc DESC) = 1""",
    ("v_weather",),
)
def _(spark, sf):
    found = A.newest_runs(_issued(spark, sf), G)
    return doubles(found.withColumn("issued_at_utc", F.date_format("issued_at_utc", "yyyy-MM-dd HH:mm:ss")))


@query(
    "information_audit",
    f"""WITH {_RUNS},
 weeks AS (SELECT DISTINCT geography, week_start_date FROM v_weather UNION ALL SELECT 'none', week_start_date FROM (SELECT DISTINCT week_start_date FROM v_weather)),
 eligible AS (SELECT * FROM weeks WHERE week_start_date >= DATE '1998-01-01'),
 covered AS (SELECT DISTINCT e.* FROM eligible e JOIN runs r USING (geography, week_start_date) WHERE r.issued_at_utc <= CAST(e.week_start_date - 1 AS TIMESTAMP)),
 numbered AS (SELECT *, week_start_date - CAST(7 * row_number() OVER (PARTITION BY geography ORDER BY week_start_date) AS INTEGER) AS island FROM covered),
 runs_of AS (SELECT geography, island, min(week_start_date) AS lo, max(week_start_date) AS hi, count(*) AS n FROM numbered GROUP BY ALL),
 c AS (SELECT geography, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi, count(*) AS islands, max(n) AS longest FROM runs_of GROUP BY ALL),
 e AS (SELECT geography, count(*) FILTER (WHERE week_start_date >= DATE '1998-01-01') AS n FROM weeks GROUP BY ALL)
SELECT e.geography, CASE WHEN coalesce(c.n, 0) = 0 THEN 'no_archived_weeks' ELSE 'complete' END AS status, '{A.BASIS}' AS weather_basis,
 1 AS issue_days_before_target_week, 0 AS issue_run_hour_utc, e.n AS eligible_archived_weeks, coalesce(c.n, 0) AS covered_weeks,
 e.n - coalesce(c.n, 0) AS uncovered_archived_weeks, c.lo AS coverage_start, c.hi AS coverage_end, coalesce(islands, 0) AS coverage_islands,
 coalesce(longest, 0) AS longest_island_weeks FROM e LEFT JOIN c USING (geography)""",
    ("v_weather",),
)
def _(spark, sf):
    """Coverage of the labelled weeks by runs issued in time; the series ``none`` has weeks and no run."""
    weeks = cut_lineage(area_weekly(spark, sf).select(*G, WEEK))
    labelled = weeks.unionByName(weeks.select(F.lit("none").alias("geography"), WEEK).distinct())
    runs = A.newest_runs(_issued(spark, sf), G)
    return A.audit_coverage(labelled, runs, G, F.lit("1998-01-01").cast("date"))
