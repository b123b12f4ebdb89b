"""Shared growth of many models, per-series fits, correlations from moments, city calendars, audit, slots."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import audit as A
from weekloom.operators import boosting as B
from weekloom.operators import city as Y
from weekloom.operators import finalfit as FF
from weekloom.operators import metrics as M
from weekloom.operators import models as ML
from weekloom.operators import policy as P
from weekloom.operators.quality import QualityError
from weekloom.operators.trees import TreeSettings

G = ["geography"]
FEW = TreeSettings(rounds=5, step=0.3, depth=3, lineage_every=2)


def noisy(spark, series=("a", "b"), n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in series:
        for i in range(n):
            x, z = rng.random(2)
            rows.append((g, 2000 + i // 60, float(x), float(z) if rng.random() < 0.9 else None, float(20 * x + 10 * (z > 0.5) + rng.exponential(2))))
    return spark.createDataFrame(rows, "geography string, year int, x double, z double, y double")


def goals():
    return [
        B.Goal("half", F.col("y"), F.lit(1.0)),
        B.Goal("p80", F.col("y"), F.when(F.col("x") < 0.7, 2.0).otherwise(0.0), 0.8),
        B.Goal("high", (F.col("y") > 15).cast("double"), F.when(F.col("y") > 15, 2.0).otherwise(0.5), None),
        B.Goal("nobody", F.col("y"), F.lit(0.0)),
    ]


def test_one_series_refit_equals_the_shared_fit(spark):
    df = noisy(spark).cache()
    nodes = B.grow_each(df, G, ["x", "z"], goals(), FEW).cache()
    assert {r.tag for r in nodes.select("tag").distinct().collect()} == {"half", "p80", "high"}
    for g in ("a", "b"):
        own = df.where(F.col("geography") == g)
        shared = B.grow(own, ["x", "z"], goals(), FEW)
        assert set(shared) == {"half", "p80", "high"}
        scored = B.score_each(own, nodes, G, ["x", "z"], {"half": "s_half", "p80": "s_p80", "high": "s_high"})
        filled = scored.withColumn("z", F.coalesce("z", F.lit(float("nan"))))
        for tag, model in shared.items():
            filled = filled.withColumn(f"m_{tag}", model.column(["x", "z"]))
        filled = filled.withColumn("s_high", 1 / (1 + F.exp(-F.col("s_high"))))
        gaps = filled.agg(*[F.max(F.abs(F.col(f"s_{t}") - F.col(f"m_{t}"))).alias(t) for t in shared]).first()
        assert max(gaps) < 1e-9


def test_folds_grown_together_equal_folds_grown_alone(spark):
    df = noisy(spark).cache()
    early = F.col("year") < 2002
    folds = [B.Goal(str(y), F.col("y"), (F.col("year") < y).cast("double"), q) for y, q in ((2002, 0.5), (2003, 0.8))]
    both = B.grow(df, ["x"], folds, FEW, early)
    for goal in folds:
        alone = B.grow(df, ["x"], [goal], FEW, early)[goal.tag]
        assert alone.start == both[goal.tag].start
        pair = df.select(alone.column(["x"]).alias("p"), both[goal.tag].column(["x"]).alias("q"))
        assert pair.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_log_loss_ranks_and_quantiles_cover(spark):
    df = noisy(spark, n=400).cache()
    found = B.grow(df, ["x", "z"], goals()[:3], TreeSettings(rounds=25, step=0.2, depth=3))
    scored = df.withColumn("z", F.coalesce("z", F.lit(float("nan")))).select(
        "*", found["high"].column(["x", "z"]).alias("p"), found["p80"].column(["x", "z"]).alias("q"), found["half"].column(["x", "z"]).alias("m")
    )
    r = scored.agg(
        F.avg(F.when(F.col("y") > 15, F.col("p"))).alias("up"), F.avg(F.when(F.col("y") <= 15, F.col("p"))).alias("down"),
        F.avg(F.when(F.col("x") < 0.7, (F.col("y") <= F.col("q")).cast("double"))).alias("share"),
        F.avg(F.abs(F.col("y") - F.col("m"))).alias("mae"), F.avg(F.abs(F.col("y") - 15)).alias("flat"),
    ).first()
    assert r.up > r.down + 0.4 and 0.74 <= r.share <= 0.88 and r.mae < 0.5 * r.flat


def history(spark, names=("a", "b"), years=range(2000, 2005)):
    rng = np.random.default_rng(1)
    rows = []
    for k, g in enumerate(names):
        for y in years:
            for w in range(1, 53):
                heat = float(10 * np.sin(w / 8) + rng.random())
                rows.append((g, y, w, date.fromisocalendar(y, w, 1), int(20 + 10 * k + heat + rng.integers(0, 4)), heat if rng.random() < 0.95 else None))
    return spark.createDataFrame(rows, "geography string, year int, weekofyear int, week_start_date date, total_cases long, heat double")


def test_final_models_come_back_from_disk(spark, tmp_path):
    cases = history(spark).withColumn("flat", F.lit(1.0)).cache()
    fitted = FF.two_stage_final(cases, G, ["heat", "flat"], FEW)
    FF.save_final(fitted, str(tmp_path), "v1")
    FF.save_final(fitted, str(tmp_path), "v1")  # replaces itself
    single = FF.single_stage_fit(cases.where("geography = 'a'"), G, ["heat", "flat"], FEW)
    FF.save_final(single, str(tmp_path), "v2")
    with pytest.raises(QualityError):
        FF.load_final(spark, str(tmp_path), "v3", G)
    models = FF.load_final(spark, str(tmp_path), "v1", G)
    assert models.weather == ["heat", "flat"] and models.nodes.count() == fitted.nodes.count()
    facts = {r.geography: r for r in models.facts.collect()}
    assert facts["a"].training_rows == 260 and facts["b"].training_end == date.fromisocalendar(2004, 52, 1)
    scenario = [(g, date(2005, 1, 3), 1, h, 1.0, [float(c)] * 8, last) for g in "ab" for h, c, last in ((9.0, 35, 30.0), (-9.0, 10, None))]
    rows = spark.createDataFrame(
        scenario, "geography string, week_start_date date, weekofyear int, heat double, flat double, last_8_cases array<double>, cases_last_year double"
    )
    ready = FF.scenario_rows(models, rows).cache()
    median = {r.geography: r["median"] for r in models.medians.where("feature = 'cases_lag_52'").collect()}
    assert {r.geography: r.cases_lag_52 for r in ready.where("heat_chosen_lag < 0").collect()} == median
    one, two = FF.score_scenarios(models, ready).collect(), FF.score_scenarios(fitted, ready).collect()
    key = lambda r: (r.geography, r.heat_chosen_lag)
    for x, y in zip(sorted(one, key=key), sorted(two, key=key), strict=True):
        assert x == y and x.single_stage_prediction >= 0 and 0 <= x.outbreak_probability <= 1
        assert x.two_stage_mae_prediction >= 0 and x.mae_policy_alert in (True, False)
    alone = FF.score_scenarios(FF.load_final(spark, str(tmp_path), "v2", G), ready.where("geography = 'a'")).collect()
    both = {key(r): r.single_stage_prediction for r in one}
    assert all(r.single_stage_prediction == pytest.approx(both[key(r)]) for r in alone)


def test_five_thousand_series_in_one_job(spark):
    rows = spark.range(5000).selectExpr("CAST(id AS STRING) AS geography", "explode(sequence(0, 5)) AS k", "id % 50 AS level").selectExpr(
        "geography", "CAST(k AS DOUBLE) AS x", "CAST(level + 3 * k AS DOUBLE) AS y"
    )
    nodes = B.grow_each(rows, G, ["x"], [B.Goal("m", F.col("y"), F.lit(1.0))], TreeSettings(rounds=1, step=1.0, depth=3))
    scored = B.score_each(rows, nodes, G, ["x"], {"m": "p"})
    assert scored.count() == 30000 and scored.agg(F.max(F.abs(F.col("y") - F.col("p")))).first()[0] < 7


def test_calibration_of_all_series_at_once(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(p), int(rng.random() < min(1, p * k))) for g, k in (("a", 1.0), ("b", 0.5)) for p in rng.random(300)]
    rows += [("c", 0.4, 1)] * 5
    df = spark.createDataFrame(rows, "geography string, p double, y int")
    found = {r.geography: r for r in ML.calibration_curves(df, G, "p", "y").collect()}
    assert found["c"].slope is None
    for g in "ab":
        alone = ML.probability_calibrator(df.where(F.col("geography") == g), "p", "y")
        assert found[g].slope == pytest.approx(alone.slope) and found[g].intercept == pytest.approx(alone.intercept)


# --- correlations ----------------------------------------------------------------------

def test_constant_and_empty_columns_have_no_correlation(spark):
    rows = [(i % 2, float(i), 2.5, None, float(i * i), float("1e12") + i) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, x double, flat double, gone double, y double, far double")
    found = {(r.k, r.left_column, r.right_column): r.correlation for r in M.pairwise_corr(df, ["x", "flat", "gone", "y", "far"], ["k"]).collect()}
    assert found[0, "x", "x"] == pytest.approx(1) and found[0, "x", "far"] == pytest.approx(1)
    assert found[1, "x", "flat"] is None and found[1, "flat", "flat"] is None and found[0, "x", "gone"] is None
    x = np.array([r[1] for r in rows if r[0] == 0])
    assert found[0, "x", "y"] == pytest.approx(np.corrcoef(x, x * x)[0, 1])


def test_moments_of_years_merge_into_those_of_all(spark):
    cases = history(spark)
    whole = M.lag_moments(cases, G, "total_cases", ["heat"], 4)
    parts = M.lag_moments(cases, G, "total_cases", ["heat"], 4, parts=["year"])
    merged = M.merged_moments(parts, [*G, "column_name", "lag_weeks"])
    key = lambda r: (r.geography, r.lag_weeks)
    for a, b in zip(sorted(whole.collect(), key=key), sorted(merged.collect(), key=key), strict=True):
        assert [getattr(b, m) for m in M.MOMENTS] == pytest.approx([getattr(a, m) for m in M.MOMENTS])


def test_best_lag_of_each_range_from_one_table(spark):
    rows = [("a", date(2000, 1, 3) + timedelta(weeks=i), float(np.sin(i / 3)), float(np.sin((i - 15) / 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "geography string, week_start_date date, heat double, cases double")
    table = M.lag_corr(df, G, "cases", ["heat"], 20).cache()
    found = {k: M.best_lag(table, G, maximum_lag=k).first().best_lag for k in (8, 12, 20)}
    assert found[20] == 15 and found[12] <= 12 and found[8] <= 8


# --- city calendars --------------------------------------------------------------------

def test_cities_keep_their_own_weeks(spark):
    """One city starts weeks on Sunday and numbers them one ahead, the other on Monday."""
    rows, days = [], []
    rng = np.random.default_rng(4)
    for g, first, offset in (("mon", date(1999, 1, 4), 0), ("sun", date(1999, 1, 3), 1)):
        for i in range(52 * 8):
            week = first + timedelta(weeks=i)
            n = (week.isocalendar().week + offset - 1) % 53 + 1
            rows.append((g, week.isocalendar().year, n, week, int(20 + 10 * np.sin(n / 8) + rng.integers(0, 4))))
            days += [(g, week + timedelta(days=d), float(n % 9), "archive") for d in range(7)]
        days += [(g, first + timedelta(weeks=52 * 8, days=d), 1.0, "forecast") for d in range(21)]
    cases = spark.createDataFrame(rows, "geography string, year int, weekofyear int, week_start_date date, total_cases long").cache()
    from weekloom import schemas as S

    daily = spark.createDataFrame(days, "geography string, date date, v double, weather_source string")
    daily = daily.select("geography", "date", "weather_source", *[(F.col("v") + i).alias(c) for i, c in enumerate(S.DAILY_WEATHER)])
    calendar = Y.city_calendar(cases, G)
    assert {r.geography: (r.start_weekday, r.week_offset) for r in calendar.collect()} == {"mon": (0, 0), "sun": (6, 1)}
    weekly = Y.city_weeks(daily, calendar, G).cache()
    assert weekly.where("weather_days_available < 7").isEmpty()
    as_of = date(1999, 1, 4) + timedelta(weeks=52 * 8, days=2)
    targets = Y.city_targets(calendar, G, F.lit(as_of)).cache()
    starts = {(r.geography, r.lead_weeks): (r.week_start_date.weekday(), r.weekofyear, r.week_start_date.isocalendar().week) for r in targets.collect()}
    assert starts["mon", 0][0] == 0 and starts["sun", 1][0] == 6
    assert all(n == (iso + (g == "sun") - 1) % 53 + 1 for (g, _), (_, n, iso) in starts.items())
    detectors = Y.train_city_detectors(cases, weekly, G, settings=TreeSettings(rounds=2, step=0.5, depth=2))
    recent = cases.where("geography = 'mon' OR week_start_date < '2006-06-01'")
    found = Y.score_city_weeks(detectors, cases, recent, weekly, targets, G, "now", gate_override=0.0).collect()
    routes = {(r.geography, r.lead_weeks): r.model_variant for r in found}
    assert routes == {("mon", 0): "weather_plus_recent_cases", ("mon", 1): "weather_only", ("sun", 0): "weather_only", ("sun", 1): "weather_only"}
    assert all(r.outbreak_alert and r.alert_gate == 0.0 and 0 <= r.outbreak_probability <= 1 for r in found)
    missing = targets.withColumn("week_start_date", F.date_add("week_start_date", 700))
    with pytest.raises(Exception, match="complete weather days"):
        Y.score_city_weeks(detectors, cases, recent, weekly, missing, G, "now").collect()


def test_local_day_follows_the_time_zone(spark):
    df = spark.createDataFrame([("America/Lima",), ("UTC",), ("Asia/Tokyo",)], "tz string")
    found = df.select(Y.local_day(F.lit("2026-03-01 02:00:00").cast("timestamp"), F.col("tz"))).collect()
    assert [r[0] for r in found] == [date(2026, 2, 28), date(2026, 3, 1), date(2026, 3, 1)]


# --- audit and slots -------------------------------------------------------------------

def test_audit_takes_the_newest_run_before_the_decision(spark):
    week = date(2024, 4, 1)
    runs = [("a", week + timedelta(weeks=k), datetime(2024, 3, 31) + timedelta(weeks=k, hours=h), float(h)) for k in (0, 1, 3) for h in (-48, -1, 0, 5)]
    runs.append(("a", week + timedelta(weeks=2), datetime(2024, 4, 20), 9.0))  # issued too late
    issued = spark.createDataFrame(runs, "geography string, week_start_date date, issued_at_utc timestamp, rain_sum double")
    found = A.newest_runs(issued, G)
    assert {(r.week_start_date, r.rain_sum) for r in found.collect()} == {(week + timedelta(weeks=k), 0.0) for k in (0, 1, 3)}
    weeks = [(g, week + timedelta(weeks=k)) for g in "ab" for k in range(-2, 5)]
    labelled = spark.createDataFrame(weeks, "geography string, week_start_date date")
    rows = {r.geography: r for r in A.audit_coverage(labelled, found, G, F.lit("2024-04-01").cast("date")).collect()}
    assert rows["b"].status == "no_archived_weeks" and rows["b"].eligible_archived_weeks == 5 and rows["b"].coverage_start is None
    a = rows["a"]
    assert (a.status, a.covered_weeks, a.uncovered_archived_weeks, a.coverage_islands, a.longest_island_weeks) == ("complete", 3, 2, 2, 2)
    assert (a.coverage_start, a.coverage_end) == (week, week + timedelta(weeks=3))
    assert A.audit_coverage(labelled, found, G, F.lit("2024-04-01"), enabled=False).first().status == "disabled"


def test_one_series_is_promoted_alone(spark):
    schema = "geography string, model_version string"
    slots = spark.createDataFrame([("a", "old"), ("b", "old")], schema)
    new = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "new"), ("d", "new")], schema)
    verdict = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", False)], "geography string, promote boolean")
    found = {r.geography: r.model_version for r in P.merge_slots(slots, new, verdict, G).collect()}
    assert found == {"a": "new", "b": "old", "c": "new"}
