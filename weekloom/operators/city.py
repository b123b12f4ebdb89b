"""Series with calendars of their own: start weekday, week numbering, time zone; detectors and live alerts per series.

The calendar is a table of one row per series, joined into roll-up, week numbers, targets and features; nothing assumes
Monday weeks. Detectors are node tables keyed by series, so a city is fitted, scored and replaced alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage, stored_small
from weekloom.functions.calendar import epi_week, harmonics, week_floor
from weekloom.operators import features as X
from weekloom.operators import ledger as L
from weekloom.operators import metrics as M
from weekloom.operators import models as ML
from weekloom.operators import policy as P
from weekloom.operators.boosting import Goal, grow_each, score_each
from weekloom.operators.rollup import daily_to_weekly
from weekloom.operators.thresholds import expanding_outbreak_labels, seasonal_thresholds
from weekloom.operators.trees import TreeSettings

WEEK = "week_start_date"


def city_calendar(cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_weekday, week_offset): how each series begins and numbers its weeks, inferred from its rows."""
    return stored_small(M.cadence_mode(cases, keys), "calendar")


def local_day(now: Column, timezone: Column) -> Column:
    """Calendar day of a UTC time where the series is."""
    return F.to_date(F.from_utc_timestamp(now, timezone))


def city_weeks(daily: DataFrame, calendar: DataFrame, keys: list[str], as_of: Column | None = None) -> DataFrame:
    """Complete weeks of daily weather on each series' own grid, with its week numbers."""
    dated = daily.join(calendar.select(*keys, "start_weekday"), keys)
    weekly = daily_to_weekly(dated, keys, as_of=as_of, start_weekday=F.col("start_weekday"))
    return weekly.join(calendar.select(*keys, "week_offset"), keys).withColumn("weekofyear", epi_week(WEEK, "week_offset")).drop("week_offset")


def city_targets(calendar: DataFrame, keys: list[str], as_of: Column, weeks_ahead: int = 1) -> DataFrame:
    """Current week and the ``weeks_ahead`` after it of every series, on its own grid. ``as_of`` may be a column of the calendar."""
    leads = F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(weeks_ahead + 1)])).alias("lead_weeks")
    rows = calendar.select(*keys, "start_weekday", "week_offset", as_of.cast("date").alias("as_of_date"), leads)
    start = F.date_add(week_floor("as_of_date", F.col("start_weekday")), (F.col("lead_weeks") * 7).cast("int"))
    return rows.select(*keys, "as_of_date", "lead_weeks", start.alias(WEEK), epi_week(start, "week_offset").alias("weekofyear"))


@dataclass
class CityDetectors:
    """One variant's detectors of all series: trees by key, curve, gate and held-out metrics."""

    variant: str
    features: list[str]
    nodes: DataFrame
    curves: DataFrame
    gates: DataFrame
    metrics: DataFrame
    held_out: DataFrame


def city_detectors(
    frame: DataFrame, features: list[str], keys: list[str], variant: str, target_recall: float = 0.8,
    validation_years: int = 4, settings: TreeSettings = TreeSettings(), label: str = "outbreak_label",
) -> CityDetectors:
    """Time-aware detectors of every series: its last years are held out in turn, then all its rows are refitted.

    Year ranks count back from a series' own newest year, so series may cover different years. A series with fewer than
    four labelled years, or without a usable fold, gets no detector.
    """
    rows = frame.filter(F.col(label).isNotNull())
    w = Window.partitionBy(*keys)
    rank = F.dense_rank().over(w.orderBy(F.col("year").desc()))
    rows = cut_lineage(rows.select("*", rank.alias("_rank")))
    high = F.col(label).cast("int") == 1
    folds = range(validation_years + 1)  # 0: all rows
    counts = rows.groupBy(*keys).agg(
        F.max("_rank").alias("_years"),
        *[F.count_if(F.col("_rank") > k).alias(f"_n{k}") for k in folds],
        *[F.count_if((F.col("_rank") > k) & high).alias(f"_p{k}") for k in folds],
    )
    seen = cut_lineage(rows.join(stored_small(counts), keys).where("_years >= 4"))
    goals = []
    for k in folds:
        n, p = F.col(f"_n{k}"), F.col(f"_p{k}")
        two = (p > 0) & (p < n)
        balance = F.when(~two, 1.0).when(high, n / (2 * p)).otherwise(n / (2 * (n - p)))
        usable = (F.col("_rank") > k) & (two | F.lit(k == 0))
        if k:
            usable = usable & (n >= settings.minimum_train_rows) & (F.lit(k) <= F.col("_years") - 2)
        goals.append(Goal(f"fold_{k}", F.col(label).cast("double"), F.when(usable, balance).otherwise(0.0), None))
    nodes = cut_lineage(grow_each(seen, keys, features, goals, settings))
    scored = score_each(seen, nodes, keys, features, {f"fold_{k}": f"_odds_{k}" for k in folds if k})
    odds = F.coalesce(*[F.when(F.col("_rank") == k, F.col(f"_odds_{k}")) for k in folds if k])
    held = scored.select(*keys, WEEK, "year", label, (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("raw_probability"))
    held = cut_lineage(held.where("raw_probability IS NOT NULL"))
    curves = ML.calibration_curves(held, keys, "raw_probability", label)
    judged = cut_lineage(held.join(curves, keys).withColumn("probability", _calibrated("raw_probability")).drop("slope", "intercept"))
    gates = cut_lineage(P.recall_gate(judged, keys, target_recall, "probability", label))
    alerts = judged.join(gates, keys).withColumn("alert", F.col("probability") >= F.col("alert_gate"))
    metrics = (
        M.confusion(alerts, keys, "alert", label)
        .join(M.average_precision(judged, keys, "probability", label), keys)
        .join(M.brier(judged, keys, "probability", label), keys)
    )
    return CityDetectors(variant, features, nodes, curves, gates, cut_lineage(metrics), alerts)


def _calibrated(raw: str) -> Column:
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("slope") * F.col(raw) + F.col("intercept"))))
    return F.coalesce(curve, F.col(raw))


def train_city_detectors(
    cases: DataFrame, weekly_weather: DataFrame, keys: list[str], target_recall: float = 0.8, settings: TreeSettings = TreeSettings(),
    validation_years: int = 4,
) -> dict[str, CityDetectors]:
    """Both variants of every series: weather alone, and weather with the eight weeks before."""
    on = [*keys, WEEK]
    numbered = weekly_weather.drop("weekofyear").join(cases.select(*on, "weekofyear"), on)
    names = S.weather_feature_names(S.ALERT_WEATHER)
    weather = cut_lineage(X.weather_features(numbered, keys, S.ALERT_WEATHER).select(*on, *names))
    labelled = expanding_outbreak_labels(cases, keys).select(*on, "year", "outbreak_label")
    frame = cut_lineage(X.complete_rows(labelled.join(weather, on), names))
    lags = X.case_lags(cases, keys).select(*on, *S.CASE_FEATURES)
    both = cut_lineage(X.complete_rows(frame.join(lags, on), S.CASE_FEATURES))
    return {
        v: city_detectors(f, [*names, *extra], keys, v, target_recall, validation_years, settings)
        for v, f, extra in (("weather_only", frame, []), ("weather_plus_recent_cases", both, S.CASE_FEATURES))
    }


def score_city_weeks(
    detectors: dict[str, CityDetectors], cases: DataFrame, recent: DataFrame, weekly_weather: DataFrame, targets: DataFrame,
    keys: list[str], generated_at: str, gate_override: float | None = None,
) -> DataFrame:
    """Alert rows of the target weeks of every series.

    Two routes: a series whose eight weeks before the target are all known uses them, any other its weather alone.
    ``weekly_weather`` is on the series' own grid (``city_weeks``); a target week without 7 complete days is an error.
    ``cases`` set the thresholds, ``recent`` are the counts known now. A series without a detector scores NULL.
    """
    on = [*keys, WEEK]
    live = cut_lineage(X.weather_features(weekly_weather, keys, S.ALERT_WEATHER).drop("weekofyear", *harmonics("weekofyear")))
    enough = F.coalesce(F.col("weather_days_available"), F.lit(0)) >= 7
    fed = targets.join(live, on, "left").withColumn(
        "weather_days_available",
        F.when(enough, F.col("weather_days_available")).otherwise(
            F.raise_error(F.lit("a target week lacks complete weather days")).cast("bigint")
        ),
    )
    exact = X.live_exact_features(recent, targets.select(*on), keys, hospital=False).select(*on, *S.CASE_FEATURES, F.lit(True).alias("_exact"))
    variant = F.when(F.col("_exact"), "weather_plus_recent_cases").otherwise("weather_only")
    routed = fed.join(exact, on, "left").select("*", *[c.alias(n) for n, c in harmonics("weekofyear").items()], variant.alias("model_variant"))
    routed = cut_lineage(routed.drop("_exact"))
    parts = []
    for name, found in detectors.items():
        rows = routed.where(F.col("model_variant") == name)
        odds = score_each(rows, found.nodes, keys, found.features, {"fold_0": "_odds"})
        raw = odds.withColumn("_raw", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_odds"))))
        gate = F.col("alert_gate") if gate_override is None else F.lit(float(gate_override))
        held = found.metrics.select(*keys, *[F.col(m).alias(f"held_out_{m}") for m in ("precision", "recall", "f1", "pr_auc")])
        judged = raw.join(found.curves, keys, "left").join(found.gates, keys, "left").join(held, keys, "left")
        parts.append(judged.withColumn("outbreak_probability", _calibrated("_raw")).withColumn("alert_gate", gate))
    scored = parts[0].unionByName(parts[1])
    thresholds = seasonal_thresholds(cases, keys).select(*keys, "weekofyear", F.col("outbreak_threshold").alias("historical_outbreak_threshold_cases"))
    newest = L.latest_row(recent.select(*keys, F.col(WEEK).alias("latest_case_week")), keys, "latest_case_week")
    whole = scored.join(thresholds, [*keys, "weekofyear"], "left").join(newest, keys, "left")
    return whole.select(
        *keys, F.lit(generated_at).alias("generated_at_utc"), "as_of_date", WEEK, "weekofyear", "lead_weeks",
        F.when(F.col("lead_weeks") == 0, "current_week").otherwise("forecast_week").alias("time_scope"),
        "model_variant", "outbreak_probability", "alert_gate", (F.col("outbreak_probability") >= F.col("alert_gate")).alias("outbreak_alert"),
        "held_out_precision", "held_out_recall", "held_out_f1", "held_out_pr_auc", "historical_outbreak_threshold_cases",
        F.lit("seasonal_training_q75").alias("outbreak_definition"), "weather_days_available", "forecast_input_days", "weather_sources",
        "latest_case_week", (F.datediff(WEEK, "latest_case_week") / F.lit(7.0)).alias("case_data_age_weeks"),
    )
