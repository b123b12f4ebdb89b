"""The driver's tables read as surveillance data, and the registry of checked queries.

Each view exists twice: as a DataFrame here and as an SQL view in ``SQL_VIEWS``, so that a
query and its SQL form start from the same rows. Raw tables are aggregated to weeks, days
or hours first; everything behind that is as small as the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import cut_lineage
from weekloom.functions.calendar import iso_week, iso_year, week_floor
from weekloom.operators.features import case_lags
from weekloom.operators.thresholds import expanding_outbreak_labels

G = ["geography"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and, where SQL can express it, its SQL form."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, columns: list[str]) -> DataFrame:
    """Round doubles to six places so that summation order does not show."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def doubles(df: DataFrame) -> DataFrame:
    return r6(df, [c for c, t in df.dtypes if t == "double"])


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per priority and week: a weekly case table of five series, stored as the pipeline stores it.

    A reliable checkpoint stands for the stored table: raw rows are read once however often
    a query looks at its weeks.
    """
    o = table(spark, sf, "orders")
    return cut_lineage(
        o.groupBy(F.col("o_orderpriority").alias("geography"), week_floor("o_orderdate").alias("week_start_date"))
        .agg(
            F.count(F.lit(1)).alias("total_cases"),
            F.count_if(F.col("o_orderstatus") == "F").alias("hospitalized_cases"),
        )
        .select(
            "geography",
            "week_start_date",
            iso_year("week_start_date").alias("year"),
            iso_week("week_start_date").alias("weekofyear"),
            "total_cases",
            "hospitalized_cases",
        )
    )


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per customer nation and week; many inner weeks are empty."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return cut_lineage(
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").cast("string").alias("geography"), week_floor("o_orderdate").alias("week_start_date"))
        .agg(
            F.count(F.lit(1)).alias("total_cases"),
            F.count_if(F.col("o_orderstatus") == "F").alias("hospitalized_cases"),
        )
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per day in two speed classes: daily case records."""
    o = table(spark, sf, "orders")
    speed = F.when(F.col("o_orderpriority") <= "2-HIGH", "fast").otherwise("slow")
    return o.groupBy(speed.alias("geography"), F.col("o_orderdate").cast("date").alias("diagnostic_date")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("pcr_cases"),
        F.count_if(F.col("o_orderstatus") == "P").alias("igm_cases"),
        F.count_if(F.col("o_orderstatus") == "F").alias("hospitalized_cases"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Line items per status, flag and ship day: daily weather of two areas with three points each.

    Sums run over whole numbers so that rain thresholds fall alike in every engine.
    """
    li = table(spark, sf, "lineitem")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    summed = li.groupBy(
        F.col("l_linestatus").alias("geography"),
        F.col("l_returnflag").alias("weather_point"),
        F.col("l_shipdate").cast("date").alias("date"),
    ).agg(
        F.avg("l_quantity").alias("temperature_2m_mean"),
        F.max("l_quantity").alias("temperature_2m_max"),
        F.min("l_quantity").alias("temperature_2m_min"),
        (cents("l_discount") / F.lit(10.0)).alias("precipitation_sum"),
        (cents("l_tax") / F.lit(4.0)).alias("rain_sum"),
        F.count(F.lit(1)).cast("double").alias("precipitation_hours"),
        F.round(cents("l_extendedprice") / F.count(F.lit(1)) / F.lit(100000.0), 3).alias("relative_humidity_2m_mean"),
        (cents("l_discount") / F.count(F.lit(1))).alias("dew_point_2m_mean"),
        F.when(F.max("l_discount") > 0, cents("l_tax") / F.count(F.lit(1))).alias("soil_moisture_0_to_7cm_mean"),
        (cents("l_tax") / F.lit(100.0)).alias("et0_fao_evapotranspiration"),
    )
    # The grouping column is used behind the aggregate: text in its buffer would make it sort raw rows.
    return summed.withColumn("weather_source", F.concat(F.lit("archive:"), "weather_point"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour, per type and over all types: hourly weather of six locations."""
    e = table(spark, sf, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    n = F.count(F.lit(1))
    return (
        e.select("event_type", F.date_trunc("hour", "ts").alias("time"), "value")
        .groupingSets([["event_type", "time"], ["time"]], "event_type", "time")
        .agg(
            (cents / n / F.lit(100.0)).alias("temperature_2m"),
            (cents / F.lit(100000.0)).alias("precipitation"),
            (cents / F.lit(200000.0)).alias("rain"),
            n.cast("double").alias("relative_humidity_2m"),
            F.max("value").alias("dew_point_2m"),
            F.min("value").alias("soil_moisture_0_to_7cm"),
            (cents / F.lit(1000000.0)).alias("et0_fao_evapotranspiration"),
        )
        .withColumn("geography", F.coalesce("event_type", F.lit("all")))
        .drop("event_type")
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a probability made from their length."""
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(y, "doc_id").select(
        F.col("lang").alias("geography"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("probability"),
        F.col("quality").cast("int").alias("label"),
    )


def old_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier snapshot: weeks as they stood before the last half year, a few orders short."""
    o = table(spark, sf, "orders")
    early = o.filter((F.col("o_totalprice") >= 5000) & (F.col("o_orderdate") < F.lit("2001-06-01").cast("timestamp")))
    return early.groupBy(
        F.col("o_orderpriority").alias("geography"), week_floor("o_orderdate").alias("week_start_date")
    ).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("o_orderstatus") == "F").alias("hospitalized_cases"),
    )


def labelled(spark: SparkSession, sf: str, cases: DataFrame | None = None) -> DataFrame:
    return expanding_outbreak_labels(cases or weekly(spark, sf), G).withColumn(
        "outbreak_threshold", F.round("outbreak_threshold", 6)
    )


def forecasts(spark: SparkSession, sf: str, cases: DataFrame | None = None) -> DataFrame:
    """Held-out rows of a plain model: the mean of the last four weeks and wider bands."""
    cases = cases or weekly(spark, sf)
    past = case_lags(cases, G).select("geography", "week_start_date", "cases_lag_1", "cases_mean_4")
    m = F.col("cases_mean_4")
    return labelled(spark, sf, cases).join(past, [*G, "week_start_date"]).select(
        "geography",
        "week_start_date",
        "year",
        "weekofyear",
        F.col("total_cases").cast("double").alias("actual_cases"),
        "outbreak_threshold",
        F.col("outbreak_label").alias("actual_outbreak"),
        "cases_lag_1",
        m.alias("predicted_cases_p50"),
        (m * 1.25).alias("predicted_cases_p80"),
        (m * 1.5).alias("predicted_cases_p90"),
        F.round(m / (m + F.col("outbreak_threshold")), 6).alias("probability"),
    )


def ledger(spark: SparkSession, sf: str, cases: DataFrame | None = None) -> DataFrame:
    """A prediction ledger: every held-out week issued once in time and once a week ahead."""
    f = forecasts(spark, sf, cases)
    both = f.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("lead_weeks"))
    as_of = F.date_sub("week_start_date", F.col("lead_weeks") * 7)
    p, t = F.col("predicted_cases_p50"), F.col("outbreak_threshold")
    return both.select(
        "geography",
        as_of.alias("as_of_date"),
        "week_start_date",
        F.col("lead_weeks").cast("bigint").alias("lead_weeks"),
        F.concat(as_of.cast("string"), F.lit("T06:00:00Z")).alias("generated_at_utc"),
        F.when(F.col("lead_weeks") == 0, "current_week").otherwise("forecast_week").alias("time_scope"),
        F.concat(F.lit("m"), F.col("year").cast("string")).alias("model_version"),
        F.when(F.col("lead_weeks") == 0, "weather_plus_recent_cases").otherwise("weather_only").alias("model_variant"),
        (p + F.col("lead_weeks")).alias("predicted_cases_p50"),
        "predicted_cases_p80",
        "predicted_cases_p90",
        F.col("probability").alias("outbreak_probability"),
        F.lit(0.45).alias("alert_gate"),
        (F.col("probability") >= 0.45).alias("outbreak_alert"),
        t.alias("historical_outbreak_threshold_cases"),
        F.when(F.col("lead_weeks") == 0, "prospective_persisted_issue_time_inputs")
        .otherwise("not_persisted")
        .alias("input_vintage_basis"),
    )


SQL_VIEWS = {
    "v_weekly": """
  SELECT o_orderpriority AS geography, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start_date,
         CAST(isoyear(date_trunc('week', o_orderdate)) AS INTEGER) AS year,
         CAST(weekofyear(date_trunc('week', o_orderdate)) AS INTEGER) AS weekofyear,
         count(*) AS total_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS hospitalized_cases
  FROM orders GROUP BY ALL""",
    "v_sparse": """
  SELECT CAST(c_nationkey AS VARCHAR) AS geography, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start_date,
         count(*) AS total_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS hospitalized_cases
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "v_daily": """
  SELECT CASE WHEN o_orderpriority <= '2-HIGH' THEN 'fast' ELSE 'slow' END AS geography,
         CAST(o_orderdate AS DATE) AS diagnostic_date,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS pcr_cases,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS igm_cases,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS hospitalized_cases
  FROM orders GROUP BY ALL""",
    "v_point": """
  SELECT l_linestatus AS geography, l_returnflag AS weather_point, CAST(l_shipdate AS DATE) AS date,
         avg(l_quantity) AS temperature_2m_mean, max(l_quantity) AS temperature_2m_max,
         min(l_quantity) AS temperature_2m_min,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / 10.0::DOUBLE AS precipitation_sum,
         sum(CAST(round(l_tax * 100) AS BIGINT)) / 4.0::DOUBLE AS rain_sum,
         CAST(count(*) AS DOUBLE) AS precipitation_hours,
         round(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 100000.0::DOUBLE, 3)
           AS relative_humidity_2m_mean,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS dew_point_2m_mean,
         CASE WHEN max(l_discount) > 0 THEN sum(CAST(round(l_tax * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) END
           AS soil_moisture_0_to_7cm_mean,
         sum(CAST(round(l_tax * 100) AS BIGINT)) / 100.0::DOUBLE AS et0_fao_evapotranspiration,
         'archive:' || l_returnflag AS weather_source
  FROM lineitem GROUP BY ALL""",
    "v_hourly": """
  SELECT coalesce(event_type, 'all') AS geography, time, sum(c) / CAST(count(*) AS DOUBLE) / 100.0::DOUBLE AS temperature_2m,
         sum(c) / 100000.0::DOUBLE AS precipitation, sum(c) / 200000.0::DOUBLE AS rain,
         CAST(count(*) AS DOUBLE) AS relative_humidity_2m, max(value) AS dew_point_2m,
         min(value) AS soil_moisture_0_to_7cm, sum(c) / 1000000.0::DOUBLE AS et0_fao_evapotranspiration
  FROM (SELECT event_type, date_trunc('hour', ts) AS time, value, CAST(round(value * 100) AS BIGINT) AS c FROM events)
  GROUP BY GROUPING SETS ((event_type, time), (time))""",
    "v_scores": """
  SELECT lang AS geography, n_chars / (n_chars + 1000.0::DOUBLE) AS probability, CAST(quality AS INTEGER) AS label
  FROM documents JOIN labels USING (doc_id)""",
    "v_old": """
  SELECT o_orderpriority AS geography, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start_date,
         count(*) AS total_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS hospitalized_cases
  FROM orders WHERE o_totalprice >= 5000 AND o_orderdate < TIMESTAMP '2001-06-01' GROUP BY ALL""",
    "v_years": """
  SELECT DISTINCT geography, year FROM v_weekly""",
    "v_prior": """
  SELECT c.geography, c.year, count(DISTINCT p.year) AS prior_years
  FROM v_years c JOIN v_years p ON p.geography = c.geography AND p.year < c.year GROUP BY ALL""",
    "v_labelled": """
  SELECT w.geography, w.week_start_date, w.year, w.weekofyear, w.total_cases, w.hospitalized_cases,
         n.q60 AS near_outbreak_threshold, round(n.q75, 6) AS outbreak_threshold,
         CAST(w.total_cases >= n.q75 AS INTEGER) AS outbreak_label
  FROM v_weekly w JOIN v_prior y ON y.geography = w.geography AND y.year = w.year AND y.prior_years >= 3
  JOIN LATERAL (
    SELECT coalesce(quantile_cont(CAST(p.total_cases AS DOUBLE), 0.60)
             FILTER (WHERE least(abs(p.weekofyear - w.weekofyear), 53 - abs(p.weekofyear - w.weekofyear)) <= 2),
             quantile_cont(CAST(p.total_cases AS DOUBLE), 0.60)) AS q60,
           coalesce(quantile_cont(CAST(p.total_cases AS DOUBLE), 0.75)
             FILTER (WHERE least(abs(p.weekofyear - w.weekofyear), 53 - abs(p.weekofyear - w.weekofyear)) <= 2),
             quantile_cont(CAST(p.total_cases AS DOUBLE), 0.75)) AS q75
    FROM v_weekly p WHERE p.geography = w.geography AND p.year < w.year) n ON TRUE""",
    "v_lags": """
  SELECT *, CAST(lag(total_cases, 1) OVER w AS DOUBLE) AS cases_lag_1,
         CAST(lag(total_cases, 2) OVER w AS DOUBLE) AS cases_lag_2,
         CAST(lag(total_cases, 4) OVER w AS DOUBLE) AS cases_lag_4,
         CASE WHEN count(total_cases) OVER m4 = 4 THEN avg(total_cases) OVER m4 END AS cases_mean_4,
         CASE WHEN count(total_cases) OVER m8 = 8 THEN avg(total_cases) OVER m8 END AS cases_mean_8
  FROM v_weekly
  WINDOW w AS (PARTITION BY geography ORDER BY week_start_date),
         m4 AS (PARTITION BY geography ORDER BY week_start_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
         m8 AS (PARTITION BY geography ORDER BY week_start_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
    "v_forecast": """
  SELECT l.geography, l.week_start_date, l.year, l.weekofyear, CAST(l.total_cases AS DOUBLE) AS actual_cases,
         l.outbreak_threshold, l.outbreak_label AS actual_outbreak, g.cases_lag_1,
         g.cases_mean_4 AS predicted_cases_p50, g.cases_mean_4 * 1.25::DOUBLE AS predicted_cases_p80,
         g.cases_mean_4 * 1.5::DOUBLE AS predicted_cases_p90,
         round(g.cases_mean_4 / (g.cases_mean_4 + l.outbreak_threshold), 6) AS probability
  FROM v_labelled l JOIN v_lags g USING (geography, week_start_date)""",
    "v_ledger": """
  SELECT geography, CAST(week_start_date - CAST(7 * lead AS INTEGER) AS DATE) AS as_of_date, week_start_date,
         CAST(lead AS BIGINT) AS lead_weeks,
         CAST(CAST(week_start_date - CAST(7 * lead AS INTEGER) AS DATE) AS VARCHAR) || 'T06:00:00Z' AS generated_at_utc,
         CASE WHEN lead = 0 THEN 'current_week' ELSE 'forecast_week' END AS time_scope,
         'm' || CAST(year AS VARCHAR) AS model_version,
         CASE WHEN lead = 0 THEN 'weather_plus_recent_cases' ELSE 'weather_only' END AS model_variant,
         predicted_cases_p50 + lead AS predicted_cases_p50, predicted_cases_p80, predicted_cases_p90,
         probability AS outbreak_probability, 0.45::DOUBLE AS alert_gate, probability >= 0.45 AS outbreak_alert,
         outbreak_threshold AS historical_outbreak_threshold_cases,
         CASE WHEN lead = 0 THEN 'prospective_persisted_issue_time_inputs' ELSE 'not_persisted' END AS input_vintage_basis
  FROM v_forecast, (VALUES (0), (1)) AS leads(lead)""",
}

_NEEDS = {
    "v_years": ("v_weekly",),
    "v_prior": ("v_years",),
    "v_labelled": ("v_prior",),
    "v_lags": ("v_weekly",),
    "v_forecast": ("v_labelled", "v_lags"),
    "v_ledger": ("v_forecast",),
    "v_spatial": ("v_point",),
    "v_weather": ("v_spatial",),
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix a statement with the views it uses, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    if not order:
        return sql.strip()
    body = sql.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"
