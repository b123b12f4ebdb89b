"""Lags, delays, live features, thresholds, overrides; nothing may look into the future."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.functions import rules as R
from weekloom.operators import features as X
from weekloom.operators import thresholds as H
from weekloom.operators.quality import QualityError
from weekloom.operators.routing import route_targets

G = ["geography"]
CASES = "geography string, week_start_date date, total_cases long, hospitalized_cases long"


def ramp(spark, n, first=1, start=date(2026, 1, 5), hospital=1, skip=()):
    rows = [("a", start + timedelta(weeks=i), first + i, hospital) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, CASES)


def weather_ramp(spark, n=10):
    rows = [("a", date(2026, 1, 5) + timedelta(weeks=i), *[float(i)] * len(S.WEEKLY_WEATHER)) for i in range(n)]
    return spark.createDataFrame(rows, "geography string, week_start_date date, " + ", ".join(f"{c} double" for c in S.WEEKLY_WEATHER))


def test_weather_lags_and_rollings(spark):
    rows = X.weather_features(weather_ramp(spark), G).orderBy("week_start_date").collect()
    r = rows[5]
    assert r.precipitation_sum_lag_2 == 3 and r.precipitation_sum_rolling_4 == 14
    assert r.longest_dry_spell_days_rolling_4 == 5 and r.temperature_2m_mean_rolling_4 == 3.5
    assert rows[2].precipitation_sum_rolling_4 is None and rows[1].precipitation_sum_lag_2 is None
    names = S.weather_feature_names
    assert set(names(S.ALERT_WEATHER)) < set(names(S.FORECAST_WEATHER))
    assert len(names(S.ALERT_WEATHER)) == 70 and len(names(S.FORECAST_WEATHER)) == 82


def test_exact_live_features(spark):
    target = spark.createDataFrame([("a", date(2026, 3, 2))], "geography string, week_start_date date")
    r = X.live_exact_features(ramp(spark, 8), target, G).first()
    assert (r.cases_lag_1, r.cases_lag_4, r.cases_mean_4, r.cases_mean_8, r.cases_change_1) == (8, 5, 6.5, 4.5, 1)
    assert r.hospitalized_mean_4 == 1 and round(r.hospitalization_rate_mean_4, 6) == round(4 / 26, 6)
    assert X.live_exact_features(ramp(spark, 8, skip=(3,)), target, G).count() == 0


def test_live_delayed_features_and_age(spark):
    target = spark.createDataFrame([("a", date(2026, 7, 13))], "geography string, week_start_date date")
    start = date(2026, 7, 13) - timedelta(weeks=15)
    r = X.live_delayed_features(ramp(spark, 8, start=start), target, G, 4, 12).first()
    assert r.case_report_anchor_week == date(2026, 5, 18) and r.report_age_weeks == 8
    assert (r.delayed_cases_latest, r.delayed_cases_lag_4, r.delayed_cases_mean_8) == (8, 4, 4.5)
    assert X.live_delayed_features(ramp(spark, 8, start=start, skip=(2,)), target, G, 4, 12).count() == 0
    assert X.live_delayed_features(ramp(spark, 8, start=start), target, G, 4, 7).count() == 0
    shifted = ramp(spark, 8, start=start + timedelta(days=3))
    assert X.live_delayed_features(shifted, target, G, 4, 12).count() == 0
    routed = route_targets(target, ramp(spark, 8, start=start), G).first()
    assert routed.model_variant == "weather_plus_delayed_cases" and routed.case_report_age_weeks == 8


def test_delayed_training_features(spark):
    rows = X.delayed_features(ramp(spark, 20, first=100), G, [8]).orderBy("week_start_date").collect()
    assert (rows[15].delayed_cases_latest, rows[15].delayed_cases_lag_1, rows[15].report_age_weeks) == (107, 106, 8)
    assert rows[7].delayed_cases_latest is None
    many = X.delayed_features(ramp(spark, 20), G)
    assert many.count() == 20 * 9
    with pytest.raises(ValueError):
        X.delayed_features(ramp(spark, 3), G, [0])


def test_positional_and_calendar_lags_differ_on_a_gap(spark):
    gap = ramp(spark, 12, skip=(5,))
    by_row = {r.week_start_date: r for r in X.case_lags(gap, G).collect()}
    by_date = {r.week_start_date: r for r in X.case_lags(gap, G, calendar=True).collect()}
    after = date(2026, 1, 5) + timedelta(weeks=6)
    assert by_row[after].cases_lag_1 == 5 and by_date[after].cases_lag_1 is None and by_date[after].cases_lag_2 == 5


def test_hospital_rate_modes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (1.0, 4.0)], "h double, c double")
    got = df.select(R.hospital_rate(F.col("h"), F.col("c")), R.hospital_rate(F.col("h"), F.col("c"), "live")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (None, 0.0), (0.25, 0.25)]


def test_future_weeks_do_not_change_features(spark):
    cases, weather = ramp(spark, 30), weather_ramp(spark, 30)
    cut = date(2026, 1, 5) + timedelta(weeks=20)
    late = F.col("week_start_date") > F.lit(cut)
    spoiled = cases.withColumn("total_cases", F.when(late, 999).otherwise(F.col("total_cases")).cast("long"))
    storm = weather.select("geography", "week_start_date", *[F.when(late, 99.0).otherwise(F.col(c)).alias(c) for c in S.WEEKLY_WEATHER])
    for make in (lambda c: X.health_features(c, G), lambda c: X.delayed_features(c, G)):
        a = make(cases).filter(~late).drop("total_cases")
        b = make(spoiled).filter(~late).drop("total_cases")
        assert a.exceptAll(b).count() == 0
    a, b = (X.weather_features(w, G).filter(~late) for w in (weather, storm))
    assert a.exceptAll(b).count() == 0


def test_issue_time_override_changes_only_the_target_week(spark):
    observed = weather_ramp(spark, 12)
    week = date(2026, 1, 5) + timedelta(weeks=11)
    issued = observed.filter(F.col("week_start_date") == F.lit(week)).select(
        "geography", "week_start_date", *[F.lit(100.0).alias(c) for c in S.WEEKLY_WEATHER], F.lit("run").alias("forecast_issue_run_utc")
    )
    r = X.issue_time_overrides(observed, issued, G).first()
    assert r.rain_sum_lag_0 == 100 if "rain_sum_lag_0" in r.asDict() else True
    assert r.precipitation_sum_lag_0 == 100 and r.precipitation_sum_lag_2 == 9 and r.forecast_issue_run_utc == "run"
    assert r.precipitation_sum_rolling_4 == 100 + 8 + 9 + 10 and r.temperature_2m_mean_rolling_4 == (100 + 27) / 4
    # The same as recomputing on a table whose target week is replaced.
    replaced = observed.filter(F.col("week_start_date") != F.lit(week)).unionByName(issued.drop("forecast_issue_run_utc"))
    names = S.weather_feature_names(S.FORECAST_WEATHER)
    again = X.weather_features(replaced, G).filter(F.col("week_start_date") == F.lit(week)).select(*names).first()
    assert [round(r[n], 9) for n in names] == [round(again[n], 9) for n in names]


def test_overrides_drop_uncovered_weeks_and_refuse_repeats(spark):
    rows = spark.createDataFrame([("a", date(2026, 1, 5), 1.0), ("a", date(2026, 1, 12), 2.0)], "geography string, week_start_date date, f double")
    new = spark.createDataFrame([("a", date(2026, 1, 12), 7.0)], rows.schema)
    on = ["geography", "week_start_date"]
    assert [r.f for r in X.apply_overrides(rows, new, on, ["f"]).collect()] == [7.0]
    with pytest.raises(Exception, match="repeats a key"):
        X.apply_overrides(rows, new.union(new), on, ["f"]).collect()
    with pytest.raises(QualityError):
        X.apply_overrides(rows, new, on, ["other"])


def five_years(spark):
    rows = [("a", y, w, date.fromisocalendar(y, w, 1), w + y - 2000) for y in range(2000, 2005) for w in range(1, 53)]
    return spark.createDataFrame(rows, "geography string, year int, weekofyear int, week_start_date date, total_cases long")


def test_expanding_labels_start_after_three_years(spark):
    got = H.expanding_outbreak_labels(five_years(spark), G).collect()
    assert {r.year for r in got} == {2003, 2004} and len(got) == 104 and all(r.outbreak_threshold is not None for r in got)
    row = next(r for r in got if r.year == 2003 and r.weekofyear == 10)
    import numpy as np

    pool = [w + y - 2000 for y in (2000, 2001, 2002) for w in range(8, 13)]
    assert row.outbreak_threshold == pytest.approx(np.quantile(pool, 0.75)) and row.near_outbreak_threshold == pytest.approx(np.quantile(pool, 0.6))
    assert row.outbreak_label == int(13 >= np.quantile(pool, 0.75))


def test_empty_neighbourhood_falls_back_to_all_earlier_rows(spark):
    rows = [("a", y, 10, date.fromisocalendar(y, 10, 1), y - 2000) for y in range(2000, 2004)]
    rows += [("a", 2003, 30, date.fromisocalendar(2003, 30, 1), 5)]
    df = spark.createDataFrame(rows, "geography string, year int, weekofyear int, week_start_date date, total_cases long")
    got = {r.weekofyear: r for r in H.expanding_outbreak_labels(df, G).collect()}
    assert got[30].outbreak_threshold == pytest.approx(1.5) and got[30].outbreak_label == 1
    table = {r.weekofyear: r for r in H.seasonal_thresholds(df, G).collect()}
    assert len(table) == 53 and table[50].outbreak_threshold == pytest.approx(3.0)


def test_cyclic_neighbours_of_week_one(spark):
    df = spark.createDataFrame([("a", 2000, 1, 5)], "geography string, year int, weekofyear int, total_cases long")
    assert sorted(r.weekofyear for r in H.seasonal_neighbours(df, G).collect()) == [1, 2, 3, 52, 53]


def test_forward_fill_uses_training_values_only(spark):
    rows = [("a", date(2026, 1, 5) + timedelta(weeks=i), v) for i, v in enumerate([None, 2.0, 4.0, None, None, 9.0])]
    df = spark.createDataFrame(rows, "geography string, week_start_date date, t double")
    medians = spark.createDataFrame([("a", 3.0)], "geography string, t double")
    got = [r.t for r in X.forward_fill(df, G, ["t"], medians).orderBy("week_start_date").collect()]
    assert got == [3.0, 2.0, 4.0, 4.0, 4.0, 9.0]


def test_folding_takes_no_longer_for_characters_of_several_letters(spark):
    import time

    from weekloom.functions.cleaning import fold_text

    text = "\U0001f600 Stra\u00dfe \ufb01n \u00bd \uac00 \u00e9 \U0001d400 " * 100
    rows = spark.createDataFrame([(i, f"{text}{i}") for i in range(600)], "i long, t string").repartition(4)
    want = " ".join(["\U0001f600 STRASSE FIN 1\u20442 \u1100\u1161 E A"] * 100)
    fold = lambda n: rows.limit(n).select("i", fold_text("t").alias("f")).collect()
    fold(1)
    began = time.time()
    assert {(r.i, r.f) for r in fold(600)} == {(i, f"{want} {i}") for i in range(600)}
    assert time.time() - began < 10
