"""Queries: sources, sinks and streams, fed by files that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage, working_path
from weekloom.functions.calendar import iso_week, iso_year
from weekloom.functions.cleaning import fold_text
from weekloom.operators import rollup as U
from weekloom.operators.joins import conform
from weekloom.plans import tables as V
from weekloom.plans.queries_policy import LEDGER_ROW, _full_ledger, snapshot
from weekloom.plans.tables import G, doubles, query
from weekloom.sources import readers, sinks
from weekloom.streaming import streams

WEEK = "week_start_date"
KEY = [*G, WEEK]
_DAILY_SQL = "SELECT geography, diagnostic_date, pcr_cases, igm_cases, hospitalized_cases FROM v_daily"


def _field(name):
    return lambda item: item[name]


def _case_table(spark, sf, rows=None):
    rows = V.weekly(spark, sf) if rows is None else rows
    stamped = rows.select(
        *KEY,
        "total_cases",
        "hospitalized_cases",
        F.lit(True).alias("complete_week"),
        F.lit("file-1").alias("source_file_id"),
        F.lit("2001-08-01").alias("source_publication_date"),
        F.lit("2001-08-02T00:00:00Z").alias("retrieved_at_utc"),
    )
    return conform(stamped, S.CASE_TABLE)


@query(
    "src_weekly_cases",
    """
SELECT geography, week_start_date, total_cases, hospitalized_cases, TRUE AS complete_week, year, weekofyear FROM v_weekly
WHERE geography IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    ("v_weekly",),
)
def _(spark, sf):
    path = working_path(spark, "weekly-csv")
    _case_table(spark, sf).write.option("header", True).csv(path)
    read = readers.read_weekly_cases(spark, path, ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return read.select(*KEY, "total_cases", "hospitalized_cases", "complete_week", "year", "weekofyear")


@query("src_daily_case_json", _DAILY_SQL, ("v_daily",))
def _(spark, sf):
    path = working_path(spark, "daily-json")
    record = F.struct(
        F.concat(F.col("diagnostic_date").cast("string"), F.lit("T00:00:00")).alias("diagnosticDate"),
        F.col("pcr_cases").alias("totalCasesPcrCount"),
        F.col("igm_cases").alias("totalCasesIgMCount"),
        F.col("hospitalized_cases").alias("totalHospitalizedCount"),
    )
    # One file is the record list of one series and year, as a source publishes it.
    lists = V.daily(spark, sf).groupBy("geography", F.year("diagnostic_date").alias("year")).agg(
        F.to_json(F.collect_list(record), {"pretty": "true"}).alias("value")
    )
    lists.write.partitionBy("geography", "year").option("compression", "gzip").text(path)
    folder = F.regexp_extract(F.input_file_name(), "geography=([^/]+)/", 1)
    return readers.read_daily_case_json(spark, path + "/geography=*/year=*", folder)


@query(
    "src_columnar_daily_json",
    "SELECT geography, weather_point, date, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in S.DAILY_WEATHER)
    + ", 'archive' AS weather_source FROM v_point",
    ("v_point",),
)
def _(spark, sf):
    path = working_path(spark, "columnar-daily")
    p = V.points(spark, sf).withColumn("year", F.year("date"))
    # One payload holds one point's year: at most 366 days.
    fields = ["date", *S.DAILY_WEATHER]
    packed = p.groupBy(*G, "weather_point", "year").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("d"))
    daily = F.struct(
        F.transform("d", lambda x: x["date"].cast("string")).alias("time"),
        *[F.transform("d", _field(c)).alias(c) for c in S.DAILY_WEATHER],
    )
    # Partition folders keep one payload per file, as a landing zone does.
    payload = F.to_json(F.struct(*G, "weather_point", daily.alias("daily")), {"ignoreNullFields": "false"})
    name = F.concat_ws("-", *G, "weather_point", "year")
    packed.select(name.alias("payload"), payload.alias("value")).write.partitionBy("payload").text(path)
    read = readers.read_columnar_daily_json(spark, path + "/payload=*", F.lit("archive"), ["geography", "weather_point"])
    return doubles(read)


_HOURLY_POINTS = ["all", "click", "error", "purchase", "signup", "view"]


@query(
    "src_columnar_hourly_json",
    "SELECT geography AS weather_point, time, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in S.HOURLY_WEATHER)
    + ", 'run:' || geography AS weather_source FROM v_hourly",
    ("v_hourly",),
)
def _(spark, sf):
    path = working_path(spark, "columnar-hourly")
    h = V.hourly(spark, sf).withColumn("week", F.date_trunc("week", "time").cast("date"))
    # A run holds one week: at most 168 hours for each of six points.
    fields = ["time", *S.HOURLY_WEATHER]
    per_point = h.groupBy("week", *G).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("h"))
    hourly = F.struct(
        F.transform("h", lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[F.transform("h", _field(c)).alias(c) for c in S.HOURLY_WEATHER],
    )
    runs = per_point.groupBy("week").agg(
        F.array_sort(F.collect_list(F.struct("geography", F.struct(hourly.alias("hourly")).alias("p")))).alias("all")
    )
    payload = F.to_json(F.transform("all", lambda x: x["p"]), {"ignoreNullFields": "false"})
    runs.select("week", payload.alias("value")).write.partitionBy("week").text(path)
    read = readers.read_columnar_hourly_json(spark, path + "/week=*", _HOURLY_POINTS, "run")
    return doubles(read.drop("run_file"))


@query(
    "src_features_labels",
    """
SELECT geography AS city, year, weekofyear, max(week_start_date) AS week_start_date,
 CAST(sum(hospitalized_cases) AS DOUBLE) AS rain, CAST(sum(total_cases) AS DOUBLE) AS total_cases FROM v_weekly GROUP BY ALL""",
    ("v_weekly",),
)
def _(spark, sf):
    base = working_path(spark, "features-labels")
    w = V.weekly(spark, sf).select(
        F.col("geography").alias("city"), "year", "weekofyear", WEEK, F.col("hospitalized_cases").alias("rain"), "total_cases"
    )
    w.drop("total_cases").write.option("header", True).csv(base + "/features")
    w.drop("rain", WEEK).write.option("header", True).csv(base + "/labels")
    return readers.read_features_labels(
        spark, base + "/features", base + "/labels", ["city", "year", "weekofyear"], ["rain"]
    )


@query(
    "src_recent_cases",
    "SELECT lower(geography) AS city, week_start_date, CAST(total_cases AS DOUBLE) AS total_cases FROM v_weekly",
    ("v_weekly",),
)
def _(spark, sf):
    path = working_path(spark, "recent-csv")
    V.weekly(spark, sf).select(
        F.concat(F.lit(" "), "geography", F.lit(" ")).alias("city"), WEEK, "total_cases"
    ).write.option("header", True).csv(path)
    known = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]
    return readers.read_recent_cases(spark, path, known)


@query(
    "src_case_level_csv",
    """
SELECT upper(c_mktsegment) || ' SAO' AS geography, CAST(isoyear(o_orderdate) AS INTEGER) AS year,
 CAST(weekofyear(o_orderdate) AS INTEGER) AS weekofyear, count(*) AS total_cases
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL""",
)
def _(spark, sf):
    path = working_path(spark, "case-csv")
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    klass = F.when(F.col("o_orderstatus") == "O", "C").when(F.col("o_orderstatus") == "P", "p ").otherwise("S")
    made = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        iso_year("o_orderdate").alias("AÑO"),
        iso_week("o_orderdate").alias("Semana"),
        F.concat(F.lower("c_mktsegment"), F.lit("  São")).alias("Departamento"),
        F.lit("Añasco").alias("Provincia"),
        F.lit("x").alias("Distrito"),
        klass.alias("Tipo dx"),
    )
    for rest, encoding in enumerate(("ISO-8859-1", "UTF-8")):  # files of both encodings in one folder
        part = made.where(F.col("o_orderkey") % 2 == rest).drop("o_orderkey")
        part.write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    rows = readers.read_case_level_csv(spark, path)
    kept = U.category_filter(rows, {"provincia": ["ANASCO"]}, "tipo_dx")
    return kept.groupBy(
        fold_text("departamento").alias("geography"),
        F.col("ano").cast("int").alias("year"),
        F.col("semana").cast("int").alias("weekofyear"),
    ).agg(F.count(F.lit(1)).alias("total_cases"))


# --- sinks -----------------------------------------------------------------------------

@query(
    "sink_canonical",
    "SELECT geography, week_start_date, total_cases, hospitalized_cases FROM v_weekly",
    ("v_weekly",),
)
def _(spark, sf):
    base = working_path(spark, "canonical")
    old = _case_table(spark, sf, V.old_weekly(spark, sf))
    sinks.write_canonical(old, base, "2001-07-01T00:00:00Z", base + "-revisions")
    sinks.write_canonical(_case_table(spark, sf), base, "2001-08-01T00:00:00Z", base + "-revisions")
    sinks.write_canonical(_case_table(spark, sf), base, "2001-08-02T00:00:00Z", base + "-revisions")  # changes nothing
    return sinks.read_canonical(spark, base).select(*KEY, "total_cases", "hospitalized_cases")


@query(
    "sink_append_log",
    """
SELECT geography, week_start_date, NULL::BIGINT AS old_total_cases, total_cases AS new_total_cases, 'new' AS change_type FROM v_old
UNION ALL SELECT w.geography, w.week_start_date, o.total_cases, w.total_cases, CASE WHEN o.geography IS NULL THEN 'new' ELSE 'revision' END
FROM v_weekly w LEFT JOIN v_old o USING (geography, week_start_date)
WHERE o.geography IS NULL OR o.total_cases <> w.total_cases OR o.hospitalized_cases <> w.hospitalized_cases""",
    ("v_weekly", "v_old"),
)
def _(spark, sf):
    base = working_path(spark, "revisions")
    old = _case_table(spark, sf, V.old_weekly(spark, sf))
    sinks.write_canonical(old, base + "-table", "2001-07-01T00:00:00Z", base)
    sinks.write_canonical(_case_table(spark, sf), base + "-table", "2001-08-01T00:00:00Z", base)
    return spark.read.parquet(base).select(*KEY, "old_total_cases", "new_total_cases", "change_type")


@query(
    "sink_ledger_upsert",
    """
SELECT geography, as_of_date, week_start_date, lead_weeks, model_version,
 round(predicted_cases_p50 + CASE WHEN as_of_date >= DATE '2001-01-01' THEN 1 ELSE 0 END, 6) AS predicted_cases_p50 FROM v_ledger""",
    ("v_ledger",),
)
def _(spark, sf):
    path = working_path(spark, "ledger")
    rows = cut_lineage(_full_ledger(spark, sf))
    sinks.upsert_ledger(rows, path)
    again = rows.filter(F.col("as_of_date") >= F.lit("2001-01-01").cast("date"))
    again = again.withColumn("predicted_cases_p50", F.col("predicted_cases_p50") + 1)
    sinks.upsert_ledger(again, path)
    sinks.upsert_ledger(again, path)  # changes nothing
    return doubles(sinks.read_ledger(spark, path).select(*LEDGER_ROW, "predicted_cases_p50"))


@query(
    "sink_vintage",
    """
SELECT geography, count(*) AS row_count, CAST(sum(total_cases) AS BIGINT) AS total_cases, TRUE AS named_by_content FROM v_old GROUP BY geography
UNION ALL SELECT geography, count(*), CAST(sum(total_cases) AS BIGINT), TRUE FROM v_weekly GROUP BY geography""",
    ("v_weekly", "v_old"),
)
def _(spark, sf):
    """Two contents written three times are two vintages; ``named_by_content``: the identity is that of the rows read back."""
    path = working_path(spark, "vintages")
    old, new = cut_lineage(_case_table(spark, sf, V.old_weekly(spark, sf))), cut_lineage(_case_table(spark, sf))
    for table in (old, new, new):
        sinks.write_case_vintage(table, path)
    stored = spark.read.parquet(path)
    found = stored.groupBy(*G, "vintage_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum("total_cases").alias("total_cases"))
    named = sinks.current_vintages(old, G).unionByName(sinks.current_vintages(new, G)).withColumn("_named", F.lit(True))
    both = found.join(named, [*G, "vintage_id"], "left")
    return both.select(*G, "row_count", "total_cases", F.coalesce("_named", F.lit(False)).alias("named_by_content"))


@query(
    "sink_validation_rows",
    """
SELECT geography, week_start_date, v AS forecast_variant, round(CASE WHEN v = 'weather_only' THEN predicted_cases_p50 ELSE cases_lag_1 END, 6) AS predicted_cases_p50
FROM v_forecast, (VALUES ('weather_only'), ('weather_plus_recent_cases')) AS t(v)""",
    ("v_forecast",),
)
def _(spark, sf):
    path = working_path(spark, "validation")
    f = V.forecasts(spark, sf)
    parts = [
        f.select(*KEY, F.lit(v).alias("forecast_variant"), F.col(c).alias("predicted_cases_p50"))
        for v, c in (("weather_only", "predicted_cases_p50"), ("weather_plus_recent_cases", "cases_lag_1"))
    ]
    sinks.write_validation_rows(parts, path)
    return doubles(spark.read.parquet(path))


@query(
    "sink_alerts",
    "SELECT geography, week_start_date, lead_weeks, outbreak_probability FROM v_ledger WHERE outbreak_alert",
    ("v_ledger",),
)
def _(spark, sf):
    path = working_path(spark, "alerts")
    sinks.write_alerts(V.ledger(spark, sf).filter("outbreak_alert").select(*KEY, "lead_weeks", "outbreak_probability"), path)
    return spark.read.parquet(path)


@query(
    "sink_serving_json",
    """
SELECT w.geography, count(*) AS weeks, CAST(sum(total_cases) AS BIGINT) AS cases FROM v_weekly w
WHERE geography IN (SELECT geography FROM v_ledger) GROUP BY ALL""",
    ("v_ledger",),
)
def _(spark, sf):
    path = working_path(spark, "serving")
    sinks.write_serving_json(snapshot(spark, sf), path)
    lines = spark.read.schema("geography string, history array<struct<totalCases: bigint>>").json(path)
    return lines.select(
        "geography",
        F.size("history").cast("bigint").alias("weeks"),
        F.aggregate("history", F.lit(0).cast("bigint"), lambda a, x: a + x["totalCases"]).alias("cases"),
    )


# --- streams ---------------------------------------------------------------------------

def _stream(spark, sf, name):
    schema = V.table(spark, sf, name).schema
    return streams.read_folder(spark, sf, f"{name}.parquet", schema)


@query(
    "stream_weekly_rollup",
    """
SELECT o_orderpriority AS geography, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start_date, count(*) AS total_cases,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS hospitalized_cases
FROM orders WHERE date_trunc('week', o_orderdate) + INTERVAL 7 DAY <= (SELECT max(o_orderdate) - INTERVAL 28 DAY FROM orders) GROUP BY ALL""",
)
def _(spark, sf):
    o = _stream(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("geography"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderstatus"
    )
    weekly = streams.weekly_rollup(
        o, G, {"total_cases": F.count(F.lit(1)), "hospitalized_cases": F.count_if(F.col("o_orderstatus") == "F")}
    )
    return streams.run_to_table(spark, weekly, working_path(spark, "stream-weekly"))


@query(
    "stream_hourly_daily",
    """
SELECT event_type AS geography, CAST(ts AS DATE) AS date, round(avg(value), 6) AS temperature_2m_mean, max(value) AS temperature_2m_max,
 min(value) AS temperature_2m_min, round(sum(value), 6) AS precipitation_sum, round(sum(value / 2), 6) AS rain_sum,
 CAST(count(*) FILTER (WHERE value >= 0.1) AS DOUBLE) AS precipitation_hours, round(avg(value + 1), 6) AS relative_humidity_2m_mean,
 round(avg(value + 2), 6) AS dew_point_2m_mean, round(avg(value + 3), 6) AS soil_moisture_0_to_7cm_mean,
 round(sum(value / 4), 6) AS et0_fao_evapotranspiration, count(value) AS hours
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)
GROUP BY ALL HAVING count(value) >= 24""",
)
def _(spark, sf):
    e = _stream(spark, sf, "events").select(
        F.col("event_type").alias("geography"),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("value").alias("temperature_2m"),
        F.col("value").alias("precipitation"),
        (F.col("value") / 2).alias("rain"),
        (F.col("value") + 1).alias("relative_humidity_2m"),
        (F.col("value") + 2).alias("dew_point_2m"),
        (F.col("value") + 3).alias("soil_moisture_0_to_7cm"),
        (F.col("value") / 4).alias("et0_fao_evapotranspiration"),
    )
    return doubles(streams.run_to_table(spark, streams.hourly_daily(e, G), working_path(spark, "stream-daily")))


@query("stream_dedup", "SELECT DISTINCT * FROM events")
def _(spark, sf):
    base, names = working_path(spark, "stream-dedup"), V.table(spark, sf, "events").columns
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):  # the same rows land twice
        e.write.mode("append").parquet(base + "/landing")
    landed = spark.readStream.schema(e.schema).parquet(base + "/landing")
    return streams.run_to_table(spark, streams.dedup(landed, names), base)


@query(
    "stream_upsert",
    "SELECT geography, as_of_date, week_start_date, lead_weeks, model_version, round(predicted_cases_p50, 6) AS predicted_cases_p50 FROM v_ledger",
    ("v_ledger",),
)
def _(spark, sf):
    base = working_path(spark, "stream-upsert")
    rows = _full_ledger(spark, sf)
    for _ in range(2):  # the same issues land twice
        rows.write.mode("append").parquet(base + "/landing")
    landed = spark.readStream.schema(S.LEDGER).parquet(base + "/landing")
    streams.upsert(landed, lambda b: sinks.upsert_ledger(b, base + "/ledger"), base + "/state").awaitTermination()
    return doubles(sinks.read_ledger(spark, base + "/ledger").select(*LEDGER_ROW, "predicted_cases_p50"))


@query(
    "stream_reconcile",
    """
SELECT l.geography, l.as_of_date, l.week_start_date, l.lead_weeks, l.model_version, CAST(w.total_cases AS DOUBLE) AS actual_cases,
 CAST(w.total_cases >= l.historical_outbreak_threshold_cases AS BIGINT) AS actual_outbreak
FROM v_ledger l LEFT JOIN (SELECT * FROM v_weekly WHERE week_start_date + 6 <= DATE '2001-06-02') w USING (geography, week_start_date)""",
    ("v_ledger",),
)
def _(spark, sf):
    base = working_path(spark, "stream-reconcile")
    truth = V.weekly(spark, sf)
    sinks.upsert_ledger(_full_ledger(spark, sf, truth), base + "/ledger")
    for late in (False, True):  # outcomes become known after the ledger rows, in two deliveries
        part = truth.where((F.col(WEEK) >= "2001-01-01") == F.lit(late))
        part.write.mode("append").parquet(base + "/landing")
        landed = spark.readStream.schema(truth.schema).parquet(base + "/landing")
        streams.reconcile(
            landed, base + "/ledger", KEY, F.lit("2001-06-30").cast("date"), base + "/state"
        ).awaitTermination()
    return sinks.read_ledger(spark, base + "/ledger").select(*LEDGER_ROW, "actual_cases", "actual_outbreak")
