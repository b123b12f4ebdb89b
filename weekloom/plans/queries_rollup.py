"""Queries: calendars, scalar expressions, roll-ups, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage
from weekloom.functions import calendar as C
from weekloom.functions import cleaning as K
from weekloom.functions import rules as R
from weekloom.operators import features as X
from weekloom.operators import ledger as L
from weekloom.operators import metrics as M
from weekloom.operators import rollup as U
from weekloom.operators import spine as P
from weekloom.operators import thresholds as H
from weekloom.operators.policy import finalized
from weekloom.plans import tables as V
from weekloom.plans.tables import G, SQL_VIEWS, doubles, query

WEEK = "week_start_date"


# --- labels and thresholds -------------------------------------------------------------

@query(
    "expanding_outbreak_labels",
    """
SELECT geography, week_start_date, year, weekofyear, total_cases, hospitalized_cases,
       round(near_outbreak_threshold, 6) AS near_outbreak_threshold,
       round(outbreak_threshold, 6) AS outbreak_threshold, outbreak_label FROM v_labelled""",
    ("v_labelled",),
)
def _(spark, sf):
    return doubles(H.expanding_outbreak_labels(V.weekly(spark, sf), G))


_SEASON = """
SELECT g.geography, CAST(k.week AS INTEGER) AS weekofyear,
  round(coalesce(quantile_cont(CAST(w.total_cases AS DOUBLE), 0.60)
    FILTER (WHERE least(abs(w.weekofyear - k.week), 53 - abs(w.weekofyear - k.week)) <= 2),
    quantile_cont(CAST(w.total_cases AS DOUBLE), 0.60)), 6) AS near_outbreak_threshold,
  round(coalesce(quantile_cont(CAST(w.total_cases AS DOUBLE), 0.75)
    FILTER (WHERE least(abs(w.weekofyear - k.week), 53 - abs(w.weekofyear - k.week)) <= 2),
    quantile_cont(CAST(w.total_cases AS DOUBLE), 0.75)), 6) AS outbreak_threshold
FROM (SELECT DISTINCT geography FROM v_weekly) g, generate_series(1, 53) AS k(week), v_weekly w
WHERE w.geography = g.geography GROUP BY g.geography, k.week"""


@query("seasonal_threshold", _SEASON, ("v_weekly",))
def _(spark, sf):
    return doubles(H.seasonal_thresholds(V.weekly(spark, sf), G))


@query(
    "seasonal_neighbor_join",
    """
SELECT c.geography, c.year, c.weekofyear, count(*) AS neighbour_rows,
       CAST(sum(p.total_cases) AS DOUBLE) AS neighbour_cases
FROM v_weekly c JOIN v_weekly p ON p.geography = c.geography AND p.year < c.year
 AND least(abs(p.weekofyear - c.weekofyear), 53 - abs(p.weekofyear - c.weekofyear)) <= 2
GROUP BY ALL""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    near = H.seasonal_neighbours(w, G)
    joined = w.select(*G, "year", "weekofyear").join(near, [*G, "weekofyear"]).filter("history_year < year")
    return joined.groupBy(*G, "year", "weekofyear").agg(
        F.count(F.lit(1)).alias("neighbour_rows"), F.sum("total_cases").alias("neighbour_cases")
    )


@query(
    "seasonal_reference",
    f"""
SELECT l.geography, l.week_start_date, l.weekofyear, s.outbreak_threshold AS historical_outbreak_threshold_cases
FROM (SELECT geography, max_by(struct_pack(week_start_date, weekofyear), week_start_date) AS r FROM v_weekly GROUP BY geography) x,
 LATERAL (SELECT x.geography, x.r.week_start_date, x.r.weekofyear) l
JOIN ({_SEASON}) s ON s.geography = l.geography AND s.weekofyear = l.weekofyear""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    latest = L.latest_row(w.select(*G, WEEK, "weekofyear"), G, WEEK)
    return doubles(H.threshold_for_week(H.seasonal_thresholds(w, G), latest, G))


@query(
    "join_left_m1",
    f"""
SELECT w.geography, w.week_start_date, w.weekofyear, w.total_cases, s.near_outbreak_threshold, s.outbreak_threshold
FROM v_weekly w LEFT JOIN ({_SEASON}) s ON s.geography = w.geography AND s.weekofyear = w.weekofyear""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    rows = w.select(*G, WEEK, "weekofyear", "total_cases")
    return doubles(H.attach_thresholds(rows, H.seasonal_thresholds(w, G), G))


# --- scalar expressions ----------------------------------------------------------------

@query(
    "week_floor",
    """
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday_start,
 CAST(CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 1 - 4 + 7) % 7 AS INTEGER) AS DATE) AS friday_start
FROM orders""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", C.week_floor("o_orderdate").alias("monday_start"), C.week_floor("o_orderdate", 4).alias("friday_start"))


@query(
    "iso_fields",
    """
SELECT o_orderkey, CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week FROM orders""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", C.iso_year("o_orderdate").alias("iso_year"), C.iso_week("o_orderdate").alias("iso_week"))


@query(
    "iso_week_to_date",
    """
SELECT iso_year, iso_week,
  CASE WHEN isoyear(d) = iso_year AND weekofyear(d) = iso_week THEN d END AS week_start_date
FROM (SELECT *, CAST(date_trunc('week', make_date(iso_year, 1, 4)) AS DATE) + 7 * (iso_week - 1) AS d
      FROM (SELECT DISTINCT CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year FROM orders),
           (SELECT CAST(k AS INTEGER) AS iso_week FROM generate_series(0, 54) AS s(k)))""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    years = o.select(C.iso_year("o_orderdate").alias("iso_year")).distinct()
    grid = years.select("iso_year", F.explode(F.sequence(F.lit(0), F.lit(54))).alias("iso_week"))
    return grid.select("iso_year", "iso_week", C.iso_week_start("iso_year", "iso_week").alias(WEEK))


@query(
    "epi_week",
    """
SELECT o_orderkey, CAST((weekofyear(o_orderdate) + 3 - 1) % 53 + 1 AS INTEGER) AS epi_week_ahead,
       CAST((weekofyear(o_orderdate) - 2 - 1 + 53) % 53 + 1 AS INTEGER) AS epi_week_behind FROM orders""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(
        "o_orderkey", C.epi_week("o_orderdate", 3).alias("epi_week_ahead"), C.epi_week("o_orderdate", -2).alias("epi_week_behind")
    )


@query(
    "seasonal_harmonics",
    """
SELECT geography, week_start_date, round(sin(2 * pi() * weekofyear / 52.0), 6) AS week_sin_1,
 round(cos(2 * pi() * weekofyear / 52.0), 6) AS week_cos_1, round(sin(4 * pi() * weekofyear / 52.0), 6) AS week_sin_2,
 round(cos(4 * pi() * weekofyear / 52.0), 6) AS week_cos_2 FROM v_weekly""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    return doubles(w.select(*G, WEEK, *[c.alias(n) for n, c in C.harmonics("weekofyear").items()]))


@query(
    "missing_flags",
    "SELECT geography, weather_point, date, "
    + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in S.DAILY_WEATHER)
    + " FROM v_point",
    ("v_point",),
)
def _(spark, sf):
    flagged = X.missing_flags(V.points(spark, sf), S.DAILY_WEATHER)
    return flagged.select(*G, "weather_point", "date", *[f"{c}_missing" for c in S.DAILY_WEATHER])


@query(
    "text_fold",
    r"""
SELECT doc_id, CAST(length(f) AS BIGINT) AS folded_chars, md5(f) AS folded_md5 FROM (
 SELECT doc_id, trim(regexp_replace(strip_accents(upper(replace(text, 'ß', 'SS'))), '\s+', ' ', 'g')) AS f FROM documents)""",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    folded = d.select("doc_id", K.fold_text("text").alias("f"))
    return folded.select("doc_id", F.length("f").cast("bigint").alias("folded_chars"), F.md5("f").alias("folded_md5"))


def case_rows(spark, sf):
    """Orders as case records: nation, diagnosis class, ISO year and week."""
    o, c, n = V.table(spark, sf, "orders"), V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    klass = F.when(F.col("o_orderstatus") == "O", " c ").when(F.col("o_orderstatus") == "P", "P").otherwise("s")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            "o_orderkey",
            F.concat(F.lower("c_mktsegment"), F.lit(" ")).alias("departamento"),
            F.concat(F.lit(" "), F.lower("n_name"), F.lit("  ")).alias("distrito"),
            klass.alias("tipo_dx"),
            C.iso_year("o_orderdate").cast("string").alias("ano"),
            C.iso_week("o_orderdate").cast("string").alias("semana"),
        )
    )


# The place names and classes wanted are settings of the caller.
PLACES = {"departamento": ["BUILDING", "MACHINERY", "HOUSEHOLD"]}

_CASES = """
 (SELECT o_orderkey, upper(n_name) AS geography, o_orderstatus, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus IN ('O', 'P') AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"""


@query("category_filter", f"SELECT o_orderkey, geography FROM {_CASES}")
def _(spark, sf):
    kept = U.category_filter(case_rows(spark, sf), PLACES, "tipo_dx")
    return kept.select("o_orderkey", K.fold_text("distrito").alias("geography"))


@query(
    "case_level_weekly",
    f"""
SELECT b.geography, b.week_start_date, count(o_orderkey) AS total_cases, TRUE AS complete_week
FROM (SELECT geography, CAST(unnest(generate_series(min(week_start_date), max(week_start_date), INTERVAL 7 DAY)) AS DATE) AS week_start_date
      FROM {_CASES} GROUP BY geography) b
LEFT JOIN {_CASES} c ON c.geography = b.geography AND c.week_start_date = b.week_start_date
GROUP BY ALL""",
)
def _(spark, sf):
    found = U.case_rows_weekly(case_rows(spark, sf), PLACES, "tipo_dx", "distrito")
    return found.select(*G, WEEK, "total_cases", "complete_week")


@query(
    "tolerant_parse",
    """
SELECT event_id, source, CASE WHEN isfinite(n) THEN n END AS number_value,
  CAST(round_even(CASE WHEN isfinite(n) THEN n END, 0) AS BIGINT) AS integer_value,
  CASE WHEN lower(trim(t)) IN ('true', '1', 'yes') THEN TRUE WHEN lower(trim(t)) IN ('false', '0', 'no') THEN FALSE END
    AS boolean_value,
  CASE WHEN source = 'time' THEN CAST(epoch(TRY_CAST(t AS TIMESTAMP)) AS BIGINT) END AS timestamp_seconds
FROM (SELECT event_id, source, t, TRY_CAST(t AS DOUBLE) AS n FROM (
  SELECT event_id, 'k' AS source, json_extract_string(props, '$.k') AS t FROM events
  UNION ALL SELECT event_id, 'type' AS source, event_type AS t FROM events
  UNION ALL SELECT event_id, 'value' AS source, ' ' || CAST(value AS VARCHAR) || ' ' AS t FROM events
  UNION ALL SELECT event_id, 'time' AS source, CASE WHEN value > 50 THEN 'no time' WHEN value > 20 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS t FROM events
  UNION ALL SELECT event_id, 'flag' AS source, CASE WHEN value > 50 THEN ' True' WHEN value > 20 THEN 'NO ' ELSE 'NaN' END AS t FROM events))""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    flag = F.when(F.col("value") > 50, " True").when(F.col("value") > 20, "NO ").otherwise("NaN")
    day, second = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(F.col("value") > 50, "no time").when(F.col("value") > 20, second).otherwise(day)
    long = e.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("event_type").alias("type"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("value"),
        time.alias("time"),
        flag.alias("flag"),
    ).unpivot(["event_id"], ["k", "type", "value", "time", "flag"], "source", "t")
    return long.select(
        "event_id",
        "source",
        K.parse_number("t").alias("number_value"),
        K.parse_integer("t").alias("integer_value"),
        K.parse_boolean("t").alias("boolean_value"),
        F.when(F.col("source") == "time", F.unix_timestamp(K.parse_timestamp("t"))).alias("timestamp_seconds"),
    )


@query(
    "nonfinite_to_null",
    """
SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE round(value, 6) END AS value FROM events""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    v = F.col("value")
    spoiled = F.when(v > 300, F.lit(float("inf"))).when(v > 200, F.lit(float("-inf"))).when(v > 100, F.lit(float("nan"))).otherwise(v)
    return doubles(X.nonfinite_to_null(e.select("event_id", spoiled.alias("value")), ["value"]))


@query(
    "finalized_filter",
    """
SELECT * FROM v_weekly WHERE week_start_date + 6 <=
  (SELECT CAST(max(week_start_date) AS DATE) + 9 - 28 FROM v_weekly)""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    as_of = w.agg(F.date_add(F.max(WEEK), 9).alias("_as_of"))
    return finalized(w.crossJoin(F.broadcast(as_of)), F.col("_as_of")).drop("_as_of")


@query(
    "ordered_quantiles",
    """
SELECT geography, week_start_date, round(p50, 6) AS p50, round(greatest(p80, p50), 6) AS p80, round(greatest(p90, p80, p50), 6) AS p90
FROM (SELECT *, greatest(m80, p50 + 1.5) AS p80, greatest(m90, p50 + 2.5) AS p90 FROM (
  SELECT geography, week_start_date, greatest(0, cases_lag_1 + 0.5::DOUBLE * (cases_mean_4 - cases_lag_1)) AS p50,
   greatest(0, cases_lag_1 + 0.75::DOUBLE * (cases_lag_2 - cases_lag_1)) AS m80,
   greatest(0, cases_lag_1 + 1.25::DOUBLE * (cases_lag_4 - cases_lag_1)) AS m90
  FROM v_lags WHERE cases_mean_4 IS NOT NULL))""",
    ("v_lags",),
)
def _(spark, sf):
    rows = X.case_lags(V.weekly(spark, sf), G).filter("cases_mean_4 IS NOT NULL")
    base = F.col("cases_lag_1")
    q = R.ordered_quantiles(
        F.col("cases_mean_4") - base,
        F.col("cases_lag_2") - base,
        F.col("cases_lag_4") - base,
        base,
        (0.5, 0.75, 1.25),
        (1.5, 2.5),
    )
    return doubles(rows.select(*G, WEEK, *[c.alias(n) for n, c in q.items()]))


@query(
    "two_stage_select",
    """
SELECT geography, week_start_date, round(CASE WHEN probability >= 0.45 THEN predicted_cases_p90 ELSE predicted_cases_p50 END, 6) AS prediction
FROM v_forecast""",
    ("v_forecast",),
)
def _(spark, sf):
    f = V.forecasts(spark, sf)
    chosen = R.two_stage_value(F.col("probability"), F.lit(0.45), F.col("predicted_cases_p90"), F.col("predicted_cases_p50"))
    return doubles(f.select(*G, WEEK, chosen.alias("prediction")))


@query(
    "risk_level",
    """
SELECT geography, week_start_date, CASE WHEN predicted_cases_p50 >= outbreak_threshold THEN 'expected_above_threshold'
  WHEN predicted_cases_p80 >= outbreak_threshold THEN 'elevated_upper_range'
  WHEN predicted_cases_p90 >= outbreak_threshold THEN 'possible_upper_tail' ELSE 'below_threshold_range' END AS case_risk_level,
  predicted_cases_p50 >= outbreak_threshold AS p50_above_threshold,
  predicted_cases_p80 >= outbreak_threshold AS p80_above_threshold,
  predicted_cases_p90 >= outbreak_threshold AS p90_above_threshold
FROM v_forecast""",
    ("v_forecast",),
)
def _(spark, sf):
    f = V.forecasts(spark, sf)
    p = [F.col(f"predicted_cases_p{q}") for q in (50, 80, 90)]
    t = F.col("outbreak_threshold")
    return f.select(
        *G,
        WEEK,
        R.risk_level(*p, t).alias("case_risk_level"),
        *[(c >= t).alias(f"p{q}_above_threshold") for c, q in zip(p, (50, 80, 90))],
    )


@query(
    "freshness_level",
    """
SELECT geography, age, CASE WHEN age <= 2 THEN 'current' WHEN age <= 4 THEN 'delayed' ELSE 'stale' END AS freshness_level
FROM (SELECT geography, CAST(date_diff('day', max(week_start_date), DATE '2001-08-20') AS DOUBLE) / 7 AS age FROM v_sparse GROUP BY geography)""",
    ("v_sparse",),
)
def _(spark, sf):
    latest = V.sparse(spark, sf).groupBy(*G).agg(F.max(WEEK).alias("latest"))
    age = C.weeks_between(F.lit("2001-08-20").cast("date"), "latest")
    return latest.select(*G, age.alias("age"), R.freshness_level(age).alias("freshness_level"))


@query(
    "case_age",
    """
SELECT geography, week_start_date, latest_case_week, CAST(week_start_date - latest_case_week AS DOUBLE) / 7 AS case_data_age_weeks FROM (
 SELECT geography, week_start_date, max(week_start_date) OVER (PARTITION BY geography ORDER BY week_start_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_case_week
 FROM v_sparse) WHERE latest_case_week IS NOT NULL""",
    ("v_sparse",),
)
def _(spark, sf):
    w = X.Past(G)
    before = w.w.rowsBetween(-(2**31), -1)
    rows = V.sparse(spark, sf).select(*G, WEEK, F.max(WEEK).over(before).alias("latest_case_week"))
    age, _ = L.case_age("latest_case_week", WEEK)
    return rows.filter("latest_case_week IS NOT NULL").select("*", age)


# --- roll-ups --------------------------------------------------------------------------

@query(
    "weekly_case_rollup",
    """
SELECT geography, CAST(date_trunc('week', diagnostic_date) AS DATE) AS week_start_date,
  CAST(sum(pcr_cases) + sum(igm_cases) AS BIGINT) AS total_cases, CAST(sum(pcr_cases) AS BIGINT) AS pcr_cases,
  CAST(sum(igm_cases) AS BIGINT) AS igm_cases, CAST(sum(hospitalized_cases) AS BIGINT) AS hospitalized_cases, TRUE AS complete_week
FROM v_daily GROUP BY ALL HAVING count(pcr_cases) = 7 AND count(igm_cases) = 7 AND count(hospitalized_cases) = 7""",
    ("v_daily",),
)
def _(spark, sf):
    return U.weekly_case_rollup(V.daily(spark, sf), G)


@query(
    "calendar_spine",
    """
SELECT b.geography, b.diagnostic_date, d.pcr_cases, coalesce(d.igm_cases, 0) AS igm_cases
FROM (SELECT geography, CAST(unnest(generate_series(min(diagnostic_date), max(diagnostic_date), INTERVAL 1 DAY)) AS DATE) AS diagnostic_date
      FROM v_daily GROUP BY geography) b LEFT JOIN v_daily d USING (geography, diagnostic_date)""",
    ("v_daily",),
)
def _(spark, sf):
    d = V.daily(spark, sf).select(*G, "diagnostic_date", "pcr_cases", "igm_cases")
    return P.spine(d, G, "diagnostic_date", "day", zero=["igm_cases"])


_MISSING = """
SELECT b.geography, b.week_start_date
FROM (SELECT geography, CAST(unnest(generate_series(min(week_start_date), max(week_start_date), INTERVAL 7 DAY)) AS DATE) AS week_start_date
      FROM v_sparse GROUP BY geography) b ANTI JOIN v_sparse s USING (geography, week_start_date)"""


@query("anti_calendar", _MISSING, ("v_sparse",))
def _(spark, sf):
    return P.missing_steps(V.sparse(spark, sf), G, WEEK)


@query("calendar_except", _MISSING, ("v_sparse",))
def _(spark, sf):
    return P.calendar_except(V.sparse(spark, sf), G, WEEK)


@query("dq_missing_weeks", f"SELECT geography, count(*) AS missing_weeks FROM ({_MISSING}) GROUP BY geography", ("v_sparse",))
def _(spark, sf):
    return P.missing_steps(V.sparse(spark, sf), G, WEEK).groupBy(*G).agg(F.count(F.lit(1)).alias("missing_weeks"))


_AGG = {"avg": "avg", "max": "max", "min": "min", "sum": "sum"}
_complete = " AND ".join(f"{c} IS NOT NULL" for c in S.DAILY_WEATHER)
SQL_VIEWS["v_spatial"] = f"""
  SELECT geography, date, {', '.join(f'CASE WHEN point_count = 3 THEN {c} END AS {c}' for c in S.DAILY_WEATHER)},
         point_count, weather_source
  FROM (SELECT geography, date, {', '.join(f'{_AGG[k]}({c}) AS {c}' for c, k in S.AREA_AGGREGATE.items())},
               count(DISTINCT weather_point) FILTER (WHERE {_complete}) AS point_count
        FROM v_point GROUP BY ALL)
  JOIN (SELECT geography, string_agg(DISTINCT weather_source, '+' ORDER BY weather_source) AS weather_source
        FROM v_point GROUP BY ALL) USING (geography)"""
_weekly_cols = ", ".join(
    f"CASE WHEN days >= 7 THEN w_{c} END AS {c}" for c in S.WEEKLY_WEATHER if c != "longest_dry_spell_days"
)
SQL_VIEWS["v_weather"] = f"""
  SELECT geography, week_start_date, {_weekly_cols},
         CASE WHEN days >= 7 THEN CAST(dry AS DOUBLE) END AS longest_dry_spell_days, days AS weather_days_available,
         ahead AS forecast_input_days, weather_sources
  FROM (SELECT geography, CAST(date_trunc('week', date) AS DATE) AS week_start_date,
          {', '.join(f'{k}({c}) AS w_{c}' for c, k in S.WEEKLY_AGGREGATE.items())},
          CAST(count(*) FILTER (WHERE rain_sum >= 0.1) AS DOUBLE) AS w_wet_day_count,
          CAST(count(*) FILTER (WHERE rain_sum >= 10.0) AS DOUBLE) AS w_heavy_rain_day_count,
          max(rain_sum) AS w_max_daily_rainfall, count(*) FILTER (WHERE {_complete}) AS days,
          count(*) FILTER (WHERE date > DATE '2001-06-30') AS ahead,
          string_agg(DISTINCT weather_source, '+' ORDER BY weather_source) AS weather_sources
        FROM v_spatial GROUP BY ALL)
  LEFT JOIN (SELECT geography, week_start_date, max(n) AS dry FROM (
          SELECT geography, week_start_date, hit, island, CASE WHEN hit THEN count(*) ELSE 0 END AS n FROM (
            SELECT geography, week_start_date, hit, row_number() OVER (PARTITION BY geography, week_start_date ORDER BY date)
               - row_number() OVER (PARTITION BY geography, week_start_date, hit ORDER BY date) AS island
            FROM (SELECT geography, date, CAST(date_trunc('week', date) AS DATE) AS week_start_date,
                         coalesce(rain_sum < 0.1, FALSE) AS hit FROM v_spatial))
          GROUP BY geography, week_start_date, hit, island) GROUP BY geography, week_start_date) USING (geography, week_start_date)"""


def area_daily(spark, sf):
    return U.spatial_daily(V.points(spark, sf), G, expected_points=3)


def area_weekly(spark, sf):
    return cut_lineage(U.daily_to_weekly(area_daily(spark, sf), G, as_of=F.lit("2001-06-30").cast("date")))


def _round_list(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(
    "spatial_daily",
    f"SELECT geography, date, {_round_list(S.DAILY_WEATHER)}, point_count, weather_source FROM v_spatial",
    ("v_spatial",),
)
def _(spark, sf):
    return doubles(area_daily(spark, sf))


@query(
    "weather_daily_to_weekly",
    f"""SELECT geography, week_start_date, {_round_list(S.WEEKLY_WEATHER)}, weather_days_available, forecast_input_days,
  weather_sources FROM v_weather""",
    ("v_weather",),
)
def _(spark, sf):
    return doubles(area_weekly(spark, sf))


@query(
    "weather_hourly_to_daily",
    """
SELECT geography, week_start_date, date, round(avg(temperature_2m), 6) AS temperature_2m_mean,
 round(max(temperature_2m), 6) AS temperature_2m_max, round(min(temperature_2m), 6) AS temperature_2m_min,
 round(sum(precipitation), 6) AS precipitation_sum, round(sum(rain), 6) AS rain_sum,
 CAST(count(*) FILTER (WHERE precipitation >= 0.1) AS DOUBLE) AS precipitation_hours,
 round(avg(relative_humidity_2m), 6) AS relative_humidity_2m_mean, round(avg(dew_point_2m), 6) AS dew_point_2m_mean,
 round(avg(soil_moisture_0_to_7cm), 6) AS soil_moisture_0_to_7cm_mean,
 round(sum(et0_fao_evapotranspiration), 6) AS et0_fao_evapotranspiration
FROM (SELECT *, CAST(date_trunc('week', time) AS DATE) AS week_start_date, CAST(time AS DATE) AS date FROM v_hourly)
WHERE (geography, week_start_date) IN (
  SELECT (geography, wk) FROM (
    SELECT geography, CAST(date_trunc('week', time) AS DATE) AS wk, CAST(time AS DATE) AS d,
      least(count(temperature_2m), count(precipitation), count(rain), count(relative_humidity_2m), count(dew_point_2m)) AS n
    FROM v_hourly GROUP BY ALL)
  GROUP BY ALL HAVING count(*) = 7 AND min(n) >= 24)
GROUP BY ALL""",
    ("v_hourly",),
)
def _(spark, sf):
    return doubles(U.hourly_to_daily(V.hourly(spark, sf), G))


@query(
    "longest_run",
    """
SELECT geography, week_start_date, max(n) AS longest_run FROM (
 SELECT geography, week_start_date, hit, island, CASE WHEN hit THEN count(*) ELSE 0 END AS n FROM (
  SELECT geography, week_start_date, hit, row_number() OVER (PARTITION BY geography, week_start_date ORDER BY time)
     - row_number() OVER (PARTITION BY geography, week_start_date, hit ORDER BY time) AS island
  FROM (SELECT geography, time, CAST(date_trunc('week', time) AS DATE) AS week_start_date, coalesce(precipitation < 0.1, FALSE) AS hit
        FROM v_hourly)) GROUP BY geography, week_start_date, hit, island) GROUP BY geography, week_start_date""",
    ("v_hourly",),
)
def _(spark, sf):
    h = V.hourly(spark, sf).withColumn(WEEK, C.week_floor("time"))
    return U.longest_run(h, [*G, WEEK], "time", F.col("precipitation") < 0.1)


@query(
    "complete_years",
    "SELECT geography, year, count(*) AS week_count FROM v_weekly GROUP BY ALL HAVING count(*) >= 50",
    ("v_weekly",),
)
def _(spark, sf):
    return M.complete_years(V.weekly(spark, sf), G)


@query(
    "yearly_summary",
    """
SELECT geography, year, round(avg(total_cases), 6) AS mean_weekly_cases, max(total_cases) AS max_weekly_cases,
 CAST(sum(total_cases) AS BIGINT) AS total_yearly_cases, count(*) AS weeks_reported,
 round(avg(total_cases) / (SELECT avg(x.total_cases) FROM v_weekly x WHERE x.geography = w.geography), 6) AS ratio_to_series_mean
FROM v_weekly w GROUP BY geography, year""",
    ("v_weekly",),
)
def _(spark, sf):
    return doubles(M.yearly_summary(V.weekly(spark, sf), G))


@query(
    "cadence_mode",
    """
WITH t AS (SELECT geography, CAST(isodow(week_start_date) - 1 AS INTEGER) AS start_weekday,
   CAST(((weekofyear + 2 - weekofyear(week_start_date) + 26) % 53) - 26 AS INTEGER) AS week_offset FROM (
   SELECT geography, CAST(o AS DATE) AS week_start_date, CAST(weekofyear(o) AS INTEGER) AS weekofyear FROM (
     SELECT o_orderpriority AS geography, o_orderdate AS o FROM orders))),
 a AS (SELECT geography, start_weekday, row_number() OVER (PARTITION BY geography ORDER BY count(*) DESC, start_weekday) AS r FROM t GROUP BY geography, start_weekday),
 b AS (SELECT geography, week_offset, row_number() OVER (PARTITION BY geography ORDER BY count(*) DESC, week_offset) AS r FROM t GROUP BY geography, week_offset)
SELECT geography, start_weekday, week_offset FROM a JOIN b USING (geography) WHERE a.r = 1 AND b.r = 1""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderpriority").alias("geography"),
        F.col("o_orderdate").cast("date").alias(WEEK),
        (C.iso_week("o_orderdate") + 2).alias("weekofyear"),
    )
    return M.cadence_mode(rows, G)
