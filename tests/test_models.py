"""Learners, recursion and the jobs end to end on small fixtures."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import Policy
from weekloom.operators import folds as D
from weekloom.operators import forecast as W
from weekloom.operators import models as ML
from weekloom.operators import recursion as R
from weekloom.operators import rollup as U
from weekloom.plans import jobs

G = ["geography"]


def weekly(spark, years=range(2000, 2006), names=("a",)):
    rng = np.random.default_rng(0)
    rows = []
    for k, g in enumerate(names):
        for y in years:
            for w in range(1, 53):
                n = int(20 * (k + 1) + 10 * np.sin(w / 8) + rng.integers(0, 6))
                rows.append((g, y, w, date.fromisocalendar(y, w, 1), n, float(n % 7)))
    return spark.createDataFrame(rows, "geography string, year int, weekofyear int, week_start_date date, total_cases long, heat double")


def test_folds_never_train_on_later_years(spark):
    rows = D.expanding_splits(weekly(spark), G, 4).collect()
    assert {r.validation_year for r in rows} == {2002, 2003, 2004, 2005}
    assert all((r.year < r.validation_year) == (r.fold_role == "train") for r in rows)
    inner = D.inner_splits(weekly(spark), G, 3)
    assert {r.validation_year for r in inner.select("validation_year").distinct().collect()} == {2003, 2004, 2005}
    assert D.inner_splits(weekly(spark, range(2000, 2003)), G, 3).count() == 0


def test_calibrator_solves_the_penalized_fit(spark):
    rng = np.random.default_rng(1)
    p = rng.random(200)
    y = (rng.random(200) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    got = ML.probability_calibrator(df, "p", "y")
    a = b = 0.0
    for _ in range(100):  # Newton steps on sum(log loss) + a^2 / 2
        m = 1 / (1 + np.exp(-(a * p + b)))
        g = np.array([np.sum((m - y) * p) + a, np.sum(m - y)])
        w = m * (1 - m)
        h = np.array([[np.sum(w * p * p) + 1, np.sum(w * p)], [np.sum(w * p), np.sum(w)]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert got.slope == pytest.approx(a, abs=1e-3) and got.intercept == pytest.approx(b, abs=1e-3)
    assert ML.probability_calibrator(df.filter("y = 1"), "p", "y").slope is None


def test_quantile_trees_cover_their_share(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(10 * (x > 0.5) + rng.exponential(2))) for x in rng.random(600)]
    df = spark.createDataFrame(rows, "x double, y double")
    model = ML.quantile_regressor(df, ["x"], "y", 0.8, ML.TreeSettings(rounds=6, step=0.5, depth=2))
    share = model.predict(df, "q").agg(F.avg((F.col("y") <= F.col("q")).cast("double"))).first()[0]
    assert 0.72 <= share <= 0.88
    means = {r.h: r.q for r in model.predict(df, "q").groupBy((F.col("x") > 0.5).alias("h")).agg(F.avg("q").alias("q")).collect()}
    assert means[True] > means[False] + 5


def test_recursion_feeds_predictions_back(spark):
    rows = D.expanding_splits(weekly(spark, range(2000, 2003), ("a", "b")), G, 1)
    by = [*G, "validation_year"]
    step = R.linear_step(["heat"], {"cases_mean_4": 1.0, "heat": 1.0, "cases_lag_52": 0.5})
    got = R.recursive_forecast(rows, by, ["heat"], step, ["_h"], ["week_start_date", "total_cases"], {"prediction": "double"})
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {(r.geography, r.week_start_date): r for r in got.collect()}
    data = sorted(weekly(spark, range(2000, 2003), ("a", "b")).collect(), key=lambda r: r.week_start_date)
    for g in ("a", "b"):
        history = [float(r.total_cases) for r in data if r.geography == g and r.year < 2002]
        for r in [r for r in data if r.geography == g and r.year == 2002]:
            expected = float(np.mean(history[-4:])) + r.heat + 0.5 * history[-52]
            assert found[g, r.week_start_date].prediction == pytest.approx(expected)
            history.append(expected)
    assert len(found) == 104


def test_recursion_from_a_short_history(spark):
    """Weeks that do not exist count as 0 for the model; a series without training rows starts from nothing."""
    rows = [("a", 2000, date(2000, 1, 3), 4, "train"), ("a", 2000, date(2000, 1, 10), 0, "validation"), ("b", 2000, date(2000, 1, 3), 0, "validation")]
    df = spark.createDataFrame(rows, "geography string, validation_year int, week_start_date date, total_cases long, fold_role string")
    step = R.linear_step([], {"cases_lag_1": 1.0, "cases_lag_2": 10.0, "cases_change_1": 100.0}, 2.0)
    got = R.recursive_forecast(df, [*G, "validation_year"], [], step, ["_h"], ["week_start_date"], {"prediction": "double"})
    assert {r.geography: r.prediction for r in got.collect()} == {"a": 6.0, "b": 2.0}


def test_historical_evaluation_has_every_held_out_week(spark):
    got = W.evaluate_expanding(weekly(spark), G, ["heat"], 1, ML.TreeSettings(rounds=1, step=1.0, depth=1))
    rows = got.collect()
    assert len(rows) == 52 and {r.year for r in rows} == {2005}
    assert all(r.two_stage_mae_prediction >= 0 and 0 <= r.outbreak_probability <= 1 for r in rows)
    assert all((r.outbreak_probability >= r.recall_gate) == r.recall_policy_alert for r in rows)
    assert W.summarize_alerts(got).count() == 2


def test_jobs_end_to_end(spark, tmp_path):
    """Ingest, train, promote, score, reconcile and publish; a second run changes nothing."""
    h = lambda *c: F.abs(F.hash(*c))
    days = spark.sql("SELECT 'a' AS geography, explode(sequence(date'1997-01-06', date'2004-01-04', interval 1 day)) AS diagnostic_date")
    season = (F.sin(F.dayofyear("diagnostic_date") / 58.0) + 1.5) * 4
    daily = days.select(
        "*",
        (season + h("diagnostic_date") % 3).cast("bigint").alias("pcr_cases"),
        F.lit(1).cast("bigint").alias("igm_cases"),
        (h("diagnostic_date", F.lit(1)) % 2).cast("bigint").alias("hospitalized_cases"),
    )
    wdays = spark.sql("SELECT 'a' AS geography, explode(sequence(date'1996-09-02', date'2004-02-01', interval 1 day)) AS date")
    tidy = wdays.select(
        "*", *[(h("date", F.lit(c)) % 200 / 10.0).alias(c) for c in S.DAILY_WEATHER], F.lit("archive").alias("weather_source")
    )
    weather = U.daily_to_weekly(tidy, G, as_of=F.lit("2004-01-05").cast("date")).cache()
    store, stamp = jobs.Store(str(tmp_path)), "2004-01-05T00:00:00Z"
    settings = ML.TreeSettings(rounds=1, step=1.0, depth=1)
    assert jobs.ingest(daily, store, stamp, "f1", "2004-01-04")["events"] == 365
    day = F.lit("2004-01-05").cast("date")
    policy = Policy(minimum_report_age_weeks=7, maximum_report_age_weeks=9)
    decision = jobs.train_and_guard(spark, store, weather, day, stamp, policy, settings, 1).first()
    assert decision.promote and decision.candidate_trained
    again = jobs.train_and_guard(spark, store, weather, day, "2004-01-06T00:00:00Z", policy, settings, 1).first()
    assert not again.promote and not again.candidate_trained
    for _ in range(2):
        metrics = jobs.predict_and_monitor(spark, store, weather, "2004-01-05", stamp, policy)
    rows = {r.lead_weeks: r for r in spark.read.parquet(store.at("ledger")).collect()}
    assert set(rows) == {0, 1} and metrics.count() == 0
    assert rows[0].model_variant == "weather_plus_recent_cases" and rows[1].model_variant == "weather_only"
    for r in rows.values():
        assert 0 <= r.predicted_cases_p50 <= r.predicted_cases_p80 <= r.predicted_cases_p90
        assert r.outbreak_alert == (r.outbreak_probability >= r.alert_gate) and r.input_vintage_id.startswith("input-")
    assert spark.read.parquet(store.at("input_vintages")).count() == 2
    late = jobs.monitor(spark, store, F.lit("2004-06-01").cast("date"), "2004-06-01T00:00:00Z").collect()
    assert late == []  # no outcome of the scored weeks is known yet
    held = spark.read.parquet(store.at("validation_rows"))
    assert {r.forecast_variant for r in held.select("forecast_variant").distinct().collect()} == set(S.VARIANTS)
    snap = jobs.publish(spark, store).first()
    assert snap.freshness.level == "current" and len(snap.history) == 365


def test_absolute_error_falls_with_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(z), float(20 * x + 10 * (z > 0.5) + rng.exponential(2))) for x, z in rng.random((400, 2))]
    df = spark.createDataFrame(rows, "x double, z double, y double").cache()
    y = np.array([r[2] for r in rows])
    errors = []
    for rounds in (1, 12):
        model = ML.point_regressor(df, ["x", "z"], "y", ML.TreeSettings(rounds=rounds, step=0.3, depth=3))
        got = ML.predict_point(model, df, ["x", "z"], "p").select("y", "p").toPandas()
        errors.append(float((got.y - got.p).abs().mean()))
    assert errors[1] < 0.5 * errors[0] and errors[1] < 0.4 * np.abs(y - np.median(y)).mean()


def test_weights_count_rows(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 2.0, 1.0), (0.0, 9.0, 3.0)], "x double, y double, w double")
    assert ML.point_regressor(df, ["x"], "y", ML.TreeSettings(rounds=1, step=1.0), "w").start == 9.0


def test_many_trees_are_one_projection(spark):
    rng = np.random.default_rng(6)
    x = rng.random((300, 3))
    tree = ML.Tree([0, 1, -1, -1, -1], [0.5, 0.3, 0, 0, 0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0, 0, 1.0, 2.0, 3.0])
    model = ML.QuantileModel(0.5, 4.0, ["a", "b", "c"], [tree] * 270)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = model.predict(df, "p")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in got.collect():
        leaf = (2.0 if r.b <= 0.3 else 3.0) if r.a <= 0.5 else 1.0
        assert r.p == pytest.approx(4 + 270 * leaf)
    again = ML.trees_from_rows([dict(zip(("tag", "tree", "node", "feature", "threshold", "left", "right", "value"), r)) for r in ML.node_rows({"p": model})])
    assert again == {"p": model.trees}


@pytest.mark.parametrize("series", [1, 300, 900, 5000])
def test_any_number_of_series(spark, series):
    rows = spark.range(series).selectExpr("CAST(id AS STRING) AS geography", "explode(sequence(0, 3)) AS k", "id % 50 AS level").selectExpr(
        "geography", "date_add(date'2001-01-01', 7 * k) AS week_start_date", "level + k AS total_cases"
    )
    frame = ML.series_features(rows, G).filter("series_level > 0")
    model = ML.point_regressor(frame, ML.SERIES_FEATURES, "total_cases", ML.TreeSettings(rounds=1, step=1.0))
    assert model.predict(frame, "p").count() == frame.count()


def test_constant_fields_break_no_fold(spark):
    """A field that never moves has no correlation; every fold and every series is still predicted."""
    rows = weekly(spark, names=("a", "b")).withColumn("flat", F.lit(3.0)).withColumn("gone", F.lit(None).cast("double"))
    table, base = W.fold_features(rows, G, ["heat", "flat", "gone"])
    matrix = W.training_matrix(table, [*G, "validation_year"], base)
    assert matrix.where(F.exists(F.array(*base), lambda v: v.isNull() | F.isnan(v))).isEmpty()
    got = W.evaluate_expanding(rows, G, ["heat", "flat", "gone"], 4, ML.TreeSettings(rounds=2, step=0.5, depth=2))
    assert {(r.geography, r.validation_year): r["count"] for r in got.groupBy(*G, "validation_year").count().collect()} == {
        (g, y): 52 for g in "ab" for y in (2002, 2003, 2004, 2005)
    }


def test_registered_models_use_the_published_settings():
    """No registered query lowers the rounds, folds or held-out years of its operator."""
    from pathlib import Path

    from weekloom.plans import queries_city, queries_models

    for module in (queries_models, queries_city):
        text = Path(module.__file__).read_text()
        assert "rounds=" not in text and "validation_years" not in text and "folds=" not in text
    assert ML.TreeSettings() == ML.TreeSettings(rounds=90, step=0.05, depth=4)


def test_outbreak_classifier_returns_every_held_out_row(spark, monkeypatch):
    import datetime as dt

    from weekloom.plans import queries_models as Q
    from weekloom.plans import tables as V

    start, rows = dt.date(1997, 1, 6), []
    for i in range(230):
        week = start + dt.timedelta(weeks=i)
        for s in ("a", "b"):
            rows.append((s, week, week.year, int(i % 3 == 0), *[float((i * (k + 1)) % 7 + 5 * (i % 3 == 0)) for k in range(len(Q.FEATURES))]))
    frame = spark.createDataFrame(rows, "geography string, week_start_date date, year int, outbreak_label int, " + ", ".join(f"{c} double" for c in Q.FEATURES))
    monkeypatch.setattr(Q, "training_frame", lambda *_: frame)
    settings = ML.TreeSettings(rounds=2)
    monkeypatch.setattr(Q.ML, "TreeSettings", lambda: settings)
    found = V.QUERIES["outbreak_classifier"](spark, "")
    want = {(r[0], r[1], r[3], True, True) for r in rows if r[2] >= 2000}
    assert found.columns == ["geography", "week_start_date", "outbreak_label", "outbreaks_score_higher", "probability_holds"]
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_periods_of_the_surge_experiment_are_fitted_at_once(spark, monkeypatch):
    import threading
    from types import SimpleNamespace

    both = threading.Barrier(2, timeout=30)

    def fitted(rows, features, series, label, *_, **__):
        both.wait()
        return SimpleNamespace(metrics=rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")))

    monkeypatch.setattr(W, "quantile_forecaster", fitted)
    frame = spark.createDataFrame([("a", date(2000, 1, 3) + timedelta(weeks=i)) for i in range(10)], "s string, week_start_date date")
    found = W.surge_experiment(frame, ["s"], {"all": "2001-01-01", "early": "2000-01-16"}, ["x"])
    assert [tuple(r) for r in found.select("s", "period", "n").collect()] == [("a", "all", 10), ("a", "early", 2)]
