"""Fitted models of the three routes, their training, saving and scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import Policy, cut_lineage
from weekloom.functions.calendar import iso_week
from weekloom.functions.rules import risk_level
from weekloom.operators import audit as A
from weekloom.operators import features as X
from weekloom.operators import forecast as W
from weekloom.operators import ledger as L
from weekloom.operators import models as ML
from weekloom.operators import policy as P
from weekloom.operators.joins import conform, union_parts
from weekloom.operators.quality import QualityError, checked_join
from weekloom.operators.routing import route_targets
from weekloom.operators.thresholds import expanding_outbreak_labels, seasonal_thresholds

WEEK = "week_start_date"
ROUTES = {
    "weather_only": ([], None, False),
    "weather_plus_recent_cases": (S.EXACT_FEATURES, "cases_lag_1", True),
    "weather_plus_delayed_cases": (S.DELAYED_FEATURES, "delayed_cases_latest", True),
}


@dataclass
class Candidate:
    """Detectors and forecasters by route, the thresholds and one metadata row per series."""

    detectors: dict[str, W.Detector]
    forecasters: dict[str, W.Forecaster]
    thresholds: DataFrame
    metadata: DataFrame
    series: list[str]

    def report(self) -> DataFrame:
        """Metrics in long form: series, route, metric, value."""
        parts = []
        for route, detector in self.detectors.items():
            names = ["precision", "recall", "f1", "pr_auc", "brier"]
            parts.append(_long(detector.metrics, self.series, names, route))
            scored = self.forecasters[route].metrics.withColumnRenamed("mae", "case_mae")
            names = ["case_mae", "normal_week_mae", "outbreak_week_mae", "p80_coverage", "p90_coverage", "held_out_rows"]
            if "persistence_mae" in scored.columns:
                names.append("persistence_mae")
            parts.append(_long(scored, self.series, names, route))
        return union_parts(parts).filter("value IS NOT NULL")


def _long(df: DataFrame, series: list[str], names: list[str], route: str) -> DataFrame:
    wide = df.select(*series, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(series, names, "metric", "value").withColumn("route", F.lit(route))


def training_frames(
    finalized: DataFrame, weekly_weather: DataFrame, series: list[str], policy: Policy
) -> dict[str, DataFrame]:
    """Per route one frame with weather features, case features, thresholds and labels.

    Labels may be NULL: such weeks train the forecaster but not the classifier.
    """
    on = [*series, WEEK]
    names = S.weather_feature_names(S.FORECAST_WEATHER)
    # The wide feature table is materialized once; every route and fold reads it.
    weather = cut_lineage(X.weather_features(weekly_weather, series).select(*on, *names))
    labels = expanding_outbreak_labels(finalized, series).select(*on, "outbreak_threshold", "outbreak_label")
    base = checked_join(finalized, X.complete_rows(weather, names), on, "inner", "one_to_one")
    base = cut_lineage(base.join(labels, on, "left"))
    exact = X.health_features(finalized, series).select(*on, *S.EXACT_FEATURES)
    delays = range(policy.minimum_report_age_weeks, policy.maximum_report_age_weeks + 1)
    delayed = X.delayed_features(finalized, series, delays).select(*on, *S.DELAYED_FEATURES)
    return {
        "weather_only": base.join(exact, on, "left"),
        "weather_plus_recent_cases": X.complete_rows(base.join(exact, on), S.EXACT_FEATURES),
        "weather_plus_delayed_cases": X.complete_rows(base.join(delayed, on), S.DELAYED_FEATURES),
    }


def train_candidate(
    finalized: DataFrame,
    weekly_weather: DataFrame,
    series: list[str],
    policy: Policy,
    settings: ML.TreeSettings = ML.TreeSettings(),
    stamp: str = "1970-01-01T00:00:00Z",
    overrides: DataFrame | None = None,
    validation_years: int = 4,
) -> Candidate:
    """Classifiers and case forecasters of all three routes on shared features."""
    if not policy.minimum_report_age_weeks <= policy.validation_report_age_weeks <= policy.maximum_report_age_weeks:
        raise QualityError("the validation report age lies outside the training range")
    frames = training_frames(finalized, weekly_weather, series, policy)
    alert = S.weather_feature_names(S.ALERT_WEATHER)
    wide = S.weather_feature_names(S.FORECAST_WEATHER)
    detectors, forecasters = {}, {}
    for route, (extra, baseline, fallback) in ROUTES.items():
        only = ("report_age_weeks", float(policy.validation_report_age_weeks)) if route.endswith("delayed_cases") else None
        frame = cut_lineage(frames[route])
        detectors[route] = W.oof_detector(
            frame, [*alert, *extra], series, policy.target_recall, validation_years, settings, only, overrides
        )
        forecasters[route] = W.quantile_forecaster(
            frame, [*wide, *extra], series, route, baseline, validation_years, settings, only, fallback, overrides
        )
    cutoff = finalized.groupBy(*series).agg(F.max(WEEK).alias("training_data_cutoff"))
    identity = L.content_hash(finalized, series, [*series, WEEK, "total_cases", "hospitalized_cases"], "model-")
    metadata = cutoff.join(identity.select(*series, F.col("vintage_id").alias("model_version")), series).select(
        "*",
        F.lit(stamp).alias("promoted_at_utc"),
        F.lit(S.MODEL_SCHEMA_VERSION).alias("model_schema_version"),
        F.lit(S.CASE_FORECAST_SCHEMA_VERSION).alias("case_forecast_schema_version"),
    )
    return Candidate(detectors, forecasters, cut_lineage(seasonal_thresholds(finalized, series)), cut_lineage(metadata), series)


def information_audit(
    finalized: DataFrame,
    weekly_weather: DataFrame,
    issued_weather: DataFrame,
    series: list[str],
    policy: Policy,
    settings: ML.TreeSettings = ML.TreeSettings(),
    validation_years: int = 4,
    available_from: Column | None = None,
    days_before: int = 1,
    run_hour: int = 0,
) -> tuple[DataFrame | None, DataFrame]:
    """The same fits judged with forecast weather that existed before each week, and what that covers.

    ``issued_weather`` holds runs (``issued_at_utc``, week, fields); of each week the newest run issued by the decision
    counts. Returns the metrics in long form (None where no week of any series is covered) and ``audit_coverage``.
    """
    runs = cut_lineage(A.newest_runs(issued_weather, series, "issued_at_utc", days_before, run_hour))
    overrides = cut_lineage(X.issue_time_overrides(weekly_weather, runs, series))
    first = F.lit("1900-01-01").cast("date") if available_from is None else available_from
    labelled = expanding_outbreak_labels(finalized, series)
    coverage = cut_lineage(A.audit_coverage(labelled, overrides, series, first, days_before, run_hour))
    if coverage.where(F.col("status") == A.COMPLETE).isEmpty():
        return None, coverage
    audited = train_candidate(finalized, weekly_weather, series, policy, settings, overrides=overrides, validation_years=validation_years)
    return audited.report(), coverage


def score_weeks(
    candidate: Candidate,
    weather_features: DataFrame,
    cases: DataFrame,
    targets: DataFrame,
    policy: Policy,
    as_of: Column,
    generated_at: str,
    case_vintages: DataFrame | None = None,
) -> DataFrame:
    """Ledger rows of the target weeks: route, probability, quantiles, risk, provenance.

    ``targets`` holds one row per series and week with ``lead_weeks``. Every series must have
    7 complete weather days for its target weeks.
    """
    series, on = candidate.series, [*candidate.series, WEEK]
    lacking = F.col("weather_days_available") < 7
    fed = targets.join(weather_features, on, "left").withColumn(
        "weather_days_available",
        F.when(
            F.coalesce(lacking, F.lit(True)), F.raise_error(F.lit("a target week lacks complete weather days")).cast("bigint")
        ).otherwise(F.col("weather_days_available")),
    )
    routed = cut_lineage(
        fed.join(
            route_targets(targets.select(*on), cases, series, policy.minimum_report_age_weeks, policy.maximum_report_age_weeks),
            on,
        )
    )
    parts = []
    for route in ROUTES:
        detector, forecaster = candidate.detectors[route], candidate.forecasters[route]
        rows = routed.filter(F.col("model_variant") == route)
        rows = _fill_absent(rows, set(detector.features) | set(forecaster.features))
        scored = forecaster.predict(detector.score(rows, series))
        held = detector.metrics.select(
            *series, *[F.col(m).alias(f"held_out_{m}") for m in ("precision", "recall", "f1", "pr_auc", "brier")]
        ).join(
            forecaster.metrics.select(
                *series,
                F.col("mae").alias("held_out_case_mae"),
                F.col("normal_week_mae").alias("held_out_normal_week_mae"),
                F.col("outbreak_week_mae").alias("held_out_outbreak_week_mae"),
            ),
            series,
        )
        parts.append(scored.join(held, series, "left"))
    scored = union_parts(parts)
    newest = L.latest_row(cases.select(*series, F.col(WEEK).alias("latest_case_week"), *_present(cases, ["source_file_id"])), series, "latest_case_week")
    if "source_publication_date" in cases.columns:
        newest = newest.join(
            cases.groupBy(*series).agg(F.max("source_publication_date").alias("case_source_publication_date")), series
        )
    newest = newest.withColumnRenamed("source_file_id", "case_source_file_id")
    thresholds = candidate.thresholds.select(
        *series, "weekofyear", F.col("outbreak_threshold").alias("historical_outbreak_threshold_cases")
    )
    if case_vintages is not None:
        newest = newest.join(case_vintages.select(*series, F.col("vintage_id").alias("case_vintage_id")), series, "left")
    whole = (
        scored.withColumn("weekofyear", iso_week(WEEK))
        .join(thresholds, [*series, "weekofyear"], "left")
        .join(newest, series, "left")
        .join(candidate.metadata.select(*series, "model_version", "training_data_cutoff"), series)
    )
    p = [F.col(f"predicted_cases_{t}") for t in ("p50", "p80", "p90")]
    t = F.col("historical_outbreak_threshold_cases")
    filled = whole.select(
        "*",
        F.col(series[0]).alias("geography_name"),
        F.lit(generated_at).alias("generated_at_utc"),
        as_of.cast("date").alias("as_of_date"),
        F.when(F.col("lead_weeks") == 0, "current_week").otherwise("forecast_week").alias("time_scope"),
        risk_level(*p, t).alias("case_risk_level"),
        *[(c >= t).alias(f"{n}_above_threshold") for c, n in zip(p, ("p50", "p80", "p90"))],
        F.lit("seasonal_training_q75").alias("outbreak_definition"),
        (F.datediff(WEEK, "latest_case_week") / F.lit(7.0)).alias("case_data_age_weeks"),
        F.lit(S.PERSISTED_BASIS).alias("input_vintage_basis"),
    )
    return _with_input_vintage(cut_lineage(filled), candidate)


def _with_input_vintage(rows: DataFrame, candidate: Candidate) -> DataFrame:
    """Identity of the exact inputs each row was scored with."""
    features = sorted({f for d in candidate.detectors.values() for f in d.features} | {f for c in candidate.forecasters.values() for f in c.features})
    features = [f for f in features if f in rows.columns]
    about = _present(
        rows,
        ["as_of_date", "case_report_anchor_week", "case_source_file_id", "case_vintage_id", "forecast_input_days",
         "latest_case_week", "lead_weeks", "model_variant", "model_version", "weather_sources", WEEK, *candidate.series],
    )
    identity = F.sha2(L.canonical_text([*sorted(about), *features]), 256)
    return rows.withColumn("input_vintage_id", F.concat(F.lit("input-"), F.substring(identity, 1, 16)))


def ledger_rows(scored: DataFrame) -> DataFrame:
    return conform(scored, S.LEDGER)


def input_rows(scored: DataFrame, candidate: Candidate) -> DataFrame:
    """Inputs to be stored beside the ledger, features as a map."""
    names = sorted({f for d in candidate.detectors.values() for f in d.features} | {f for c in candidate.forecasters.values() for f in c.features})
    names = [n for n in names if n in scored.columns]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])
    return scored.select(
        "input_vintage_id", *candidate.series, "as_of_date", WEEK, "lead_weeks", "model_version", "model_variant",
        "generated_at_utc", F.map_from_entries(entries).alias("features"),
    ).dropDuplicates(["input_vintage_id"])


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _fill_absent(rows: DataFrame, features: set[str]) -> DataFrame:
    """A route only sees rows that have its features; the assembler still wants no NULL type."""
    return rows.select(*[F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in rows.columns])


# --- saved models ----------------------------------------------------------------------

def save_candidate(candidate: Candidate, path: str) -> None:
    """Parquet for all that is a table, the trees' nodes included."""
    spark = candidate.metadata.sparkSession
    facts = []
    for route in candidate.detectors:
        d, f = candidate.detectors[route], candidate.forecasters[route]
        d.gates.write.mode("overwrite").parquet(f"{path}/{route}/gates")
        d.metrics.write.mode("overwrite").parquet(f"{path}/{route}/alert_metrics")
        d.held_out.write.mode("overwrite").parquet(f"{path}/{route}/alert_held_out")
        f.calibration.write.mode("overwrite").parquet(f"{path}/{route}/calibration")
        f.metrics.write.mode("overwrite").parquet(f"{path}/{route}/case_metrics")
        f.held_out.write.mode("overwrite").parquet(f"{path}/{route}/case_held_out")
        nodes = spark.createDataFrame(ML.node_rows({**f.models, "classifier": d.model}), ML.NODE_SCHEMA)  # model parameters
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/{route}/trees")
        quantiles = {tag: {"quantile": m.quantile, "start": m.start} for tag, m in f.models.items()}
        facts.append(
            (route, json.dumps({
                "alert_features": d.features, "alert_start": d.model.start, "slope": d.calibrator.slope, "intercept": d.calibrator.intercept,
                "case_features": f.features, "baseline": f.baseline, "quantiles": quantiles, "series": candidate.series,
            }))
        )
    candidate.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
    candidate.metadata.write.mode("overwrite").parquet(f"{path}/metadata")
    # Written last: a bundle without its facts is not loadable.
    spark.createDataFrame(facts, "route string, facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_candidate(spark: SparkSession, path: str) -> Candidate:
    metadata = spark.read.parquet(f"{path}/metadata")
    wrong = metadata.filter(
        (F.col("model_schema_version") != S.MODEL_SCHEMA_VERSION)
        | (F.col("case_forecast_schema_version") != S.CASE_FORECAST_SCHEMA_VERSION)
    )
    if not wrong.isEmpty():
        raise QualityError("the saved models have another schema version")
    detectors, forecasters, series = {}, {}, []
    for row in spark.read.parquet(f"{path}/facts").collect():  # three rows
        route, facts = row["route"], json.loads(row["facts"])
        series = facts["series"]
        read = lambda name, route=route: spark.read.parquet(f"{path}/{route}/{name}")
        trees = ML.trees_from_rows(read("trees").collect())
        detectors[route] = W.Detector(
            ML.ProbabilityModel(0.5, facts["alert_start"], facts["alert_features"], trees.get("classifier", [])),
            ML.Calibrator(facts["slope"], facts["intercept"]),
            facts["alert_features"], read("gates"), read("alert_held_out"), read("alert_metrics"),
        )
        models = {
            tag: ML.QuantileModel(q["quantile"], q["start"], facts["case_features"], trees.get(tag, []))
            for tag, q in facts["quantiles"].items()
        }
        forecasters[route] = W.Forecaster(
            models, facts["case_features"], route, facts["baseline"], read("calibration"), read("case_held_out"),
            read("case_metrics"), series,
        )
    return Candidate(detectors, forecasters, spark.read.parquet(f"{path}/thresholds"), metadata, series)


def decide(candidate: Candidate, champions: list[tuple[Candidate, DataFrame]], policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Promotion rules and the decision per series, each against the champion in its own slot."""
    series = candidate.series
    report = candidate.report()
    old, old_models = report.filter(F.lit(False)), candidate.metadata.filter(F.lit(False))
    if champions:
        old = union_parts([c.report().join(slots.select(*series), series, "left_semi") for c, slots in champions])
        old_models = union_parts([c.metadata.join(slots.select(*series), series, "left_semi") for c, slots in champions])
    rules = cut_lineage(
        P.promotion_rules(report, old, candidate.metadata, old_models, series, policy.guardrails, policy.minimum_new_finalized_weeks)
    )
    return rules, P.promotion_decision(rules, series)
