"""Completeness, weather roll-up, spatial and hourly rules on the published small cases."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.functions import calendar as C
from weekloom.functions import cleaning as K
from weekloom.operators import rollup as U
from weekloom.operators import spine as P

G = ["geography"]


def days(start, n):
    return [start + timedelta(days=i) for i in range(n)]


def test_week_with_a_missing_measure_is_dropped(spark):
    rows = [("a", d, 2, 1, 1) for d in days(date(2026, 1, 5), 14)]
    rows[-1] = ("a", rows[-1][1], 2, None, 1)
    df = spark.createDataFrame(rows, "geography string, diagnostic_date date, pcr_cases long, igm_cases long, hospitalized_cases long")
    got = U.weekly_case_rollup(df, G).collect()
    assert [(r.week_start_date, r.total_cases, r.hospitalized_cases) for r in got] == [(date(2026, 1, 5), 21, 7)]


def test_missing_day_is_not_zero_but_missing_case_week_is(spark):
    rows = [("a", d, 1, 0, 0) for d in days(date(2026, 1, 5), 7) if d.day != 8]
    df = spark.createDataFrame(rows, "geography string, diagnostic_date date, pcr_cases long, igm_cases long, hospitalized_cases long")
    assert U.weekly_case_rollup(df, G).count() == 0
    cases = spark.createDataFrame(
        [("LORETO", "c", "2020", "52"), ("Loréto ", "P", "2020", "52"), ("loreto", "S", "2020", "52"), ("LORETO", "C", "2021", "2"), ("X", "C", "2020", "52"), ("LORETO", "C", "n/a", "3")],
        "departamento string, tipo_dx string, ano string, semana string",
    )
    kept = U.category_filter(cases, {"departamento": ["LORETO"]}, "tipo_dx")
    weekly = U.case_level_weekly(kept.withColumn("geography", F.lit("iq")), G)
    got = {r.week_start_date: r.total_cases for r in weekly.collect()}
    # ISO 2020 has 53 weeks: 52, 53, 1 and 2 follow each other.
    assert list(sorted(got.values())) == [0, 0, 1, 2] and got[date(2020, 12, 21)] == 2 and got[date(2021, 1, 4)] == 0
    assert weekly.filter("hospitalized_cases IS NOT NULL").count() == 0


def weather_rows(n, point="p", source="archive"):
    rain = [0.0, 0.0, 1.0, 12.0, 5.0, 10.0, 0.05][:n]
    out = []
    for i, d in enumerate(days(date(2026, 7, 6), n)):
        out.append(("a", point, d, 20.0 + i, 25.0 + i, 15.0 + i, 4.0, rain[i], 2.0, 70.0, 18.0, 0.3, 4.0, source))
    return out


WEATHER = "geography string, weather_point string, date date, " + ", ".join(f"{c} double" for c in S.DAILY_WEATHER) + ", weather_source string"


def test_weekly_weather_of_a_full_week(spark):
    df = spark.createDataFrame(weather_rows(7), WEATHER)
    r = U.daily_to_weekly(df, G, as_of=F.lit("2026-07-08").cast("date")).first()
    assert (r.temperature_2m_mean, r.temperature_2m_max, r.temperature_2m_min, r.precipitation_sum) == (23, 31, 15, 28)
    assert (r.wet_day_count, r.heavy_rain_day_count, r.max_daily_rainfall, r.longest_dry_spell_days) == (4, 2, 12, 2)
    assert (r.forecast_input_days, r.weather_days_available, r.weather_sources) == (4, 7, "archive")


def test_partial_week_is_null_as_a_whole_and_absent_week_is_listed(spark):
    df = spark.createDataFrame(weather_rows(6), WEATHER)
    weeks = spark.createDataFrame([("a", date(2026, 7, 6)), ("a", date(2026, 7, 13))], "geography string, week_start_date date")
    got = {r.week_start_date: r for r in U.daily_to_weekly(df, G, weeks).collect()}
    first, second = got[date(2026, 7, 6)], got[date(2026, 7, 13)]
    assert first.weather_days_available == 6 and all(first[c] is None for c in S.WEEKLY_WEATHER)
    assert (second.weather_days_available, second.weather_sources) == (0, "missing")


def test_area_day_needs_every_point(spark):
    rows = []
    for i, p in enumerate(("x", "y", "z")):
        for r in weather_rows(2, p, f"s:{p}"):
            rows.append(r[:3] + (r[3] + i, r[4] + i, r[5] - i) + r[6:])
    df = spark.createDataFrame(rows, WEATHER)
    full = {r.date: r for r in U.spatial_daily(df, G, 3).collect()}
    one = full[date(2026, 7, 6)]
    assert (one.temperature_2m_mean, one.temperature_2m_max, one.temperature_2m_min, one.point_count) == (21, 27, 13, 3)
    assert one.weather_source == "s:x+s:y+s:z"
    holed = df.withColumn("rain_sum", F.when((F.col("weather_point") == "y") & (F.col("date") == "2026-07-07"), None).otherwise(F.col("rain_sum")))
    got = {r.date: r for r in U.spatial_daily(holed, G, 3).collect()}
    assert got[date(2026, 7, 7)].point_count == 2 and all(got[date(2026, 7, 7)][c] is None for c in S.DAILY_WEATHER)
    assert got[date(2026, 7, 6)].rain_sum is not None


def test_hourly_to_daily_needs_all_hours(spark):
    hours = spark.sql("SELECT 'a' AS geography, explode(sequence(timestamp'2024-07-01', timestamp'2024-07-07 23:00', interval 1 hour)) AS time")
    df = hours.select("*", *[F.lit(0.2).alias(c) for c in S.HOURLY_WEATHER])
    got = U.hourly_to_daily(df, G).collect()
    assert len(got) == 7 and {(round(r.precipitation_sum, 6), r.precipitation_hours) for r in got} == {(4.8, 24.0)}
    holed = df.withColumn("rain", F.when(F.col("time") == F.lit("2024-07-03 05:00:00").cast("timestamp"), None).otherwise(F.col("rain")))
    assert U.hourly_to_daily(holed, G).count() == 0


def test_longest_run_forms_agree(spark):
    flags = [True, True, False, True, True, True, False]
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "geography string, i int, f boolean")
    assert U.longest_run(df, G, "i", F.col("f")).first().longest_run == 3
    assert U.longest_run(df, G, "i", ~F.col("f")).first().longest_run == 1
    assert U.longest_run(df, G, "i", F.lit(False)).first().longest_run == 0


def test_spine_and_missing_steps(spark):
    df = spark.createDataFrame([("a", date(2026, 1, 5), 1), ("a", date(2026, 1, 26), 2)], "geography string, week_start_date date, n int")
    got = P.spine(df, G, "week_start_date", "week", zero=["n"]).orderBy("week_start_date").collect()
    assert [r.n for r in got] == [1, 0, 0, 2]
    assert P.missing_steps(df, G, "week_start_date").count() == 2


def test_calendar_expressions(spark):
    df = spark.createDataFrame([(date(2027, 1, 3),), (date(2026, 12, 28),)], "d date")
    got = df.select(C.iso_year("d"), C.iso_week("d"), C.week_floor("d", 4), C.epi_week("d", 2)).collect()
    assert tuple(got[0]) == (2026, 53, date(2027, 1, 1), 2) and tuple(got[1])[:2] == (2026, 53)
    pairs = spark.createDataFrame([(2021, 53), (2020, 53)], "y int, w int")
    assert [r[0] for r in pairs.select(C.iso_week_start("y", "w")).collect()] == [None, date(2020, 12, 28)]
    with pytest.raises(Exception, match="impossible ISO year"):
        pairs.select(C.iso_week_start("y", "w", strict=True)).collect()


def test_folding_and_tolerant_parsing(spark):
    texts = [" Iquitos  ", "Añasco…½", "straße  ﬁn", "Á\tB", "한글", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(K.fold_text("t")).collect()]
    assert got == [K.fold_name(t) if t is not None else None for t in texts]
    values = spark.createDataFrame([("2.5", " TRUE"), ("3.5", "no"), ("inf", "x"), ("", None), ("abc", "1")], "n string, b string")
    rows = values.select(K.parse_number("n"), K.parse_integer("n"), K.parse_boolean("b")).collect()
    assert [tuple(r) for r in rows] == [(2.5, 2, True), (3.5, 4, False), (None, None, None), (None, None, None), (None, None, True)]
