"""Time-held-out alert detector, quantile forecaster and recursive two-stage evaluation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage, shared_folder
from weekloom.functions.calendar import harmonics
from weekloom.functions.rules import ordered_quantiles
from weekloom.operators import features as X
from weekloom.operators import metrics as M
from weekloom.operators import models as ML
from weekloom.operators import policy as P
from weekloom.operators.boosting import Goal, grow, grow_each, score_each
from weekloom.operators.folds import expanding_splits
from weekloom.operators.joins import union_parts
from weekloom.operators.quality import QualityError
from weekloom.operators.recursion import CASE_HISTORY, COURSES, POLICY, TWO_STAGE_OUTPUTS, recursive_forecast, two_stage_step
from weekloom.operators.thresholds import attach_thresholds, seasonal_thresholds

WEEK = "week_start_date"
QUANTILES = {"p50": 0.50, "p80": 0.80, "p90": 0.90}


# --- alert detector --------------------------------------------------------------------

@dataclass
class Detector:
    """Final classifier, its calibration, the gate of each series and held-out rows."""

    model: ML.ProbabilityModel
    calibrator: ML.Calibrator
    features: list[str]
    gates: DataFrame
    held_out: DataFrame
    metrics: DataFrame

    def score(self, df: DataFrame, series: list[str]) -> DataFrame:
        raw = ML.predict_probability(self.model, df, self.features, "_raw_probability")
        scored = raw.withColumn("outbreak_probability", self.calibrator.apply(F.col("_raw_probability")))
        joined = scored.join(self.gates, series, "left").drop("_raw_probability")
        return joined.withColumn("outbreak_alert", F.col("outbreak_probability") >= F.col("alert_gate"))


def _held_out_rows(rows: DataFrame, only: tuple[str, float] | None, overrides: DataFrame | None, on: list[str], features: list[str]) -> DataFrame:
    if only is not None:
        rows = rows.filter(F.col(only[0]) == F.lit(only[1]))
    if overrides is not None:
        rows = X.apply_overrides(rows, overrides, on, features)
    return rows


def oof_detector(
    frame: DataFrame,
    features: list[str],
    series: list[str],
    target_recall: float = 0.8,
    validation_years: int = 4,
    settings: ML.TreeSettings = ML.TreeSettings(),
    validation_filter: tuple[str, float] | None = None,
    overrides: DataFrame | None = None,
    label: str = "outbreak_label",
) -> Detector:
    """Fit on earlier years, predict later ones, calibrate and gate on those, refit on all.

    Calibration and metrics share the held-out rows, as in the original programs, so the
    metrics are slightly optimistic.
    """
    rows = cut_lineage(frame.filter(F.col(label).isNotNull()))
    years = ML.years_of(rows)
    if len(years) < 4:
        raise QualityError("at least four labelled years are needed")
    counts = {
        r["year"]: (r["n"], r["p"])
        for r in rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p")).collect()  # one row a year
    }
    held_years, weights = [], {}
    for year in years[-min(validation_years, len(years) - 2) :]:
        size, positives = (sum(counts[y][k] for y in years if y < year) for k in (0, 1))
        if size >= settings.minimum_train_rows and positives not in (0, size):
            held_years.append(year)
            weights[year] = _balance(F.col("year") < year, label, size, positives)
    if not held_years:
        raise QualityError("no time-held-out predictions could be made")
    size, positives = (sum(c[k] for c in counts.values()) for k in (0, 1))
    weights["final"] = _balance(F.lit(True), label, size, positives)
    # All held-out years and the final model grow together.
    goals = [Goal(str(tag), F.col(label).cast("double"), weight, None) for tag, weight in weights.items()]
    fitted = grow(rows, features, goals, settings, F.col("year") < held_years[0])
    parts = []
    for year in held_years:
        held = _held_out_rows(rows.filter(F.col("year") == year), validation_filter, overrides, [*series, WEEK], features)
        parts.append(ML.predict_probability(fitted[str(year)], held, features, "raw_probability"))
    held_out = cut_lineage(union_parts(parts).select(*series, WEEK, "year", label, "raw_probability"))
    calibrator = ML.probability_calibrator(held_out, "raw_probability", label)
    held_out = held_out.withColumn("probability", calibrator.apply(F.col("raw_probability")))
    gates = cut_lineage(P.recall_gate(held_out, series, target_recall, "probability", label))
    judged = held_out.join(gates, series).withColumn("alert", F.col("probability") >= F.col("alert_gate"))
    report = (
        M.confusion(judged, series, "alert", label)
        .join(M.average_precision(held_out, series, "probability", label), series)
        .join(M.brier(held_out, series, "probability", label), series)
        .withColumn(
            "validation_input_basis",
            F.lit("finalized_historical_weather_proxy" if overrides is None else "archived_issue_time_weather"),
        )
    )
    return Detector(fitted["final"], calibrator, features, gates, held_out, report)


def _balance(inside, label: str, size: int, positives: int):
    """Weight of a training row: both classes weigh the same in total; 1 where one of them is absent."""
    high = F.col(label).cast("int") == 1
    both = 0 < positives < size
    weight = F.when(high, F.lit(size / (2 * positives))).otherwise(F.lit(size / (2 * (size - positives)))) if both else F.lit(1.0)
    return F.when(inside, weight).otherwise(0.0)


# --- quantile forecaster ---------------------------------------------------------------

@dataclass
class Forecaster:
    """Three quantile models with the scales and offsets of each series."""

    models: dict[str, ML.QuantileModel]
    features: list[str]
    variant: str
    baseline: str | None
    calibration: DataFrame
    held_out: DataFrame
    metrics: DataFrame
    series: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        rows = df
        for tag, model in self.models.items():
            rows = model.predict(rows, f"_raw_{tag}")
        rows = rows.join(self.calibration, self.series, "left")
        return _with_quantiles(rows, self.baseline, df.columns)


def _with_quantiles(rows: DataFrame, baseline: str | None, keep: list[str]) -> DataFrame:
    """Scale, offset and order raw outputs; calibration columns sit on the rows."""
    base = F.col(baseline).cast("double") if baseline else F.lit(0.0)
    scale = [F.coalesce(F.col(f"scale_{t}"), F.lit(1.0)) if baseline else F.lit(1.0) for t in QUANTILES]
    offset = [F.coalesce(F.col(f"offset_{t}"), F.lit(0.0)) for t in ("p80", "p90")]
    made = ordered_quantiles(*[F.col(f"_raw_{t}") for t in QUANTILES], base, tuple(scale), tuple(offset))
    return rows.select(*keep, *[c.alias(f"predicted_cases_{t}") for t, c in made.items()])


def _calibration(raw: DataFrame, series: list[str], baseline: str | None, earlier: list[int], usable: set[int]) -> DataFrame:
    """Scales from the newest earlier year and offsets from up to three earlier years.

    ``raw`` holds, for every year, predictions of models fitted on the years before it, so a
    fold only has to look its years up: nothing is fitted twice.
    """
    names = {q: f"_raw_{t}" for t, q in QUANTILES.items()}
    everyone = raw.select(*series).distinct()
    none = {f"scale_{t}": 1.0 for t in QUANTILES} | {"offset_p80": 0.0, "offset_p90": 0.0}
    if len(earlier) < 3:
        return everyone.select(*series, *[F.lit(v).alias(n) for n, v in none.items()])
    out = everyone
    if baseline and earlier[-1] in usable:
        newest = raw.filter(F.col("year") == earlier[-1])
        out = out.join(P.residual_scales(newest, series, "total_cases", baseline, names), series, "left")
    else:
        out = out.select(*series, *[F.lit(1.0).alias(f"scale_{t}") for t in QUANTILES])
    pool = [y for y in earlier[-min(3, len(earlier) - 2) :] if y in usable]
    base = F.col(baseline).cast("double") if baseline else F.lit(0.0)
    pooled = raw.filter(F.col("year").isin(pool)) if pool else raw.filter(F.lit(False))
    median = F.greatest(F.lit(0.0), base + F.coalesce(F.col("scale_p50"), F.lit(1.0)) * F.col("_raw_p50"))
    errors = pooled.join(out, series).withColumn("_median", median)
    out = out.join(P.upper_offsets(errors, series, "total_cases", "_median", weekly_groups=True), series, "left")
    return out.fillna(1.0, [f"scale_{t}" for t in QUANTILES]).fillna(0.0, ["offset_p80", "offset_p90"])


def quantile_forecaster(
    frame: DataFrame,
    features: list[str],
    series: list[str],
    variant: str,
    baseline: str | None = None,
    validation_years: int = 4,
    settings: ML.TreeSettings = ML.TreeSettings(),
    validation_filter: tuple[str, float] | None = None,
    fallback: bool = False,
    overrides: DataFrame | None = None,
    minimum_labelled_years: int = 4,
) -> Forecaster:
    """Expanding P50/P80/P90 forecasts with calibrated residuals and persistence fallback.

    Models for a year are always fitted on the years before it, whatever fold uses them, so each year is
    fitted once, all in one run of the booster, and scales, offsets and metrics follow relationally.
    """
    rows = cut_lineage(X.complete_rows(frame, [*features, "total_cases"]))
    labelled = ML.years_of(rows.filter(F.col("outbreak_label").isNotNull()))
    if len(labelled) < minimum_labelled_years:
        raise QualityError("not enough labelled years for case validation")
    held_years = labelled[-min(validation_years, len(labelled) - 2) :]
    years = ML.years_of(rows)
    target = F.col("total_cases").cast("double") - (F.col(baseline).cast("double") if baseline else F.lit(0.0))
    rows = rows.withColumn("_target", target)
    sizes = {r["year"]: r["n"] for r in rows.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    # What each year's models are used for decides which quantiles it needs.
    needed: dict[int, set[str]] = {y: set(QUANTILES) for y in held_years}
    for year in [*held_years, years[-1] + 1]:
        earlier = [y for y in years if y < year]
        if len(earlier) < 3:
            continue
        for y in earlier[-min(3, len(earlier) - 2) :]:
            needed.setdefault(y, set()).add("p50")
        if baseline:
            needed[earlier[-1]] |= set(QUANTILES)
    # Training sets are nested, so the models of all years and quantiles grow together, the final ones too.
    usable = {y for y in needed if sum(n for z, n in sizes.items() if z < y) >= settings.minimum_train_rows}
    goals = [
        Goal(f"{year}_{tag}", F.col("_target"), (F.col("year") < year).cast("double"), q)
        for year in sorted(usable)
        for tag, q in QUANTILES.items()
        if tag in needed[year]
    ]
    goals += [Goal(tag, F.col("_target"), F.lit(1.0), q) for tag, q in QUANTILES.items()]
    fitted = grow(rows, features, goals, settings, F.col("year") < min(usable, default=years[-1]))
    parts = []
    for year in sorted(usable):
        held = _held_out_rows(rows.filter(F.col("year") == year), validation_filter, overrides, [*series, WEEK], features)
        for tag in QUANTILES:
            model = fitted.get(f"{year}_{tag}")
            held = model.predict(held, f"_raw_{tag}") if model else held.withColumn(f"_raw_{tag}", F.lit(None).cast("double"))
        parts.append(held)
    if not usable & set(held_years):
        raise QualityError("no time-held-out case predictions could be made")
    raw = cut_lineage(union_parts(parts))
    keep = [c for c in rows.columns if c != "_target"]
    folds = []
    for year in [y for y in held_years if y in usable]:
        cal = _calibration(raw, series, baseline, [y for y in years if y < year], usable)
        fold = raw.filter((F.col("year") == year) & F.col("outbreak_label").isNotNull()).join(cal, series, "left")
        folds.append(_with_quantiles(fold, baseline, [*keep, "offset_p80", "offset_p90"]))
    held_out = union_parts(folds).select(
        "*",
        F.col("total_cases").cast("double").alias("actual_cases"),
        F.col("outbreak_label").cast("int").alias("actual_outbreak"),
        F.lit(variant).alias("forecast_variant"),
    )
    persistence = baseline or ("cases_lag_1" if "cases_lag_1" in keep else None)
    used = None
    if fallback and baseline:
        held_out = cut_lineage(P.persistence_fallback(cut_lineage(held_out), series, persistence=baseline))
        used = held_out.groupBy(*series).agg(F.bool_or("used_persistence_fallback").alias("used_persistence_fallback"))
    else:
        held_out = cut_lineage(held_out)
    report = (
        M.mae_split(held_out, series, persistence=persistence, weekly_groups=True)
        .join(M.pinball_coverage(held_out, series), series)
        .join(M.threshold_signal(held_out, series), series)
        .withColumn(
            "validation_input_basis",
            F.lit("finalized_historical_weather_proxy" if overrides is None else "archived_issue_time_weather"),
        )
    )
    final = _calibration(raw, series, baseline, years, usable)
    if used is not None:
        report = report.join(used, series, "left")
        final = final.join(used, series, "left").select(
            *[
                F.when(F.coalesce("used_persistence_fallback", F.lit(False)), F.lit(0.0)).otherwise(F.col(c)).alias(c)
                if c == "scale_p50"
                else F.col(c)
                for c in final.columns
            ]
        )
    models = {t: fitted[t] for t in QUANTILES}
    return Forecaster(models, features, variant, baseline, cut_lineage(final), held_out, report, series)


# --- historical two-stage evaluation ---------------------------------------------------

def fold_features(
    cases: DataFrame, series: list[str], weather: list[str], folds: int = 4, maximum_lag: int = 12, minimum_weeks: int = 50
) -> tuple[DataFrame, list[str]]:
    """All folds of all series in one table: filled weather, chosen lags, thresholds, flags.

    Medians, lags and thresholds come from a fold's training rows only.
    """
    by = [*series, "validation_year"]
    shaped, names, _ = shaped_features(expanding_splits(cases, series, folds, minimum_weeks), by, weather, maximum_lag)
    return shaped, names


def shaped_features(rows: DataFrame, by: list[str], weather: list[str], maximum_lag: int = 12) -> tuple[DataFrame, list[str], DataFrame]:
    """Features of rows tagged with ``fold_role``, their names, and the lag chosen for each field."""
    tagged = X.missing_flags(rows, weather)
    train = tagged.filter("fold_role = 'train'")
    medians = train.groupBy(*by).agg(*[F.median(c).alias(c) for c in weather])
    filled = X.forward_fill(tagged, by, weather, medians)
    filled_train = filled.filter("fold_role = 'train'")
    chosen = cut_lineage(M.best_lag(M.lag_corr(filled_train, by, "total_cases", weather, maximum_lag), by))
    shaped = X.selected_lag_features(filled, by, weather, chosen, maximum_lag)
    with_season = shaped.select("*", *[c.alias(n) for n, c in harmonics("weekofyear").items()])
    thresholds = seasonal_thresholds(filled_train, by)
    names = [f"week_{fn}_{h}" for h in (1, 2) for fn in ("sin", "cos")]
    for c in weather:
        names += [f"{c}_chosen_lag", f"{c}_mean_4", f"{c}_missing"]
    return attach_thresholds(with_season, thresholds, by), names, chosen


def training_matrix(rows: DataFrame, by: list[str], base: list[str]) -> DataFrame:
    """Training rows with real past cases; gaps take the fold's medians."""
    train = X.case_lags(rows.filter("fold_role = 'train'"), by, family="historical")
    names = [*base, *CASE_HISTORY]
    clean = X.nonfinite_to_null(train, names)
    medians = clean.groupBy(*by).agg(*[F.median(c).alias(f"_med_{c}") for c in names])
    joined = clean.join(medians, by)
    rest = [c for c in train.columns if c not in names]
    return joined.select(*rest, *[F.coalesce(c, f"_med_{c}", F.lit(0.0)).alias(c) for c in names])


def two_stage_goals() -> list[Goal]:
    """Single stage, outbreak classifier and both specialists; near-outbreak weeks support the outbreak one."""
    y = F.col("total_cases")
    high, near = y >= F.col("outbreak_threshold"), y >= F.col("near_outbreak_threshold")
    return [
        Goal("single", y, F.lit(1.0)),
        Goal("classifier", high.cast("double"), F.lit(1.0), None),
        Goal("normal", y, (~high).cast("double")),
        Goal("outbreak", y, F.when(near, F.when(high, 2.0).otherwise(1.0)).otherwise(0.0)),
    ]


@dataclass
class TwoStage:
    """Models of every key: a node table, and curves with the calibration and the gates (``by``, POLICY)."""

    by: list[str]
    features: list[str]
    nodes: DataFrame
    curves: DataFrame


def two_stage_fit(matrix: DataFrame, features: list[str], by: list[str], settings: ML.TreeSettings = ML.TreeSettings()) -> TwoStage:
    """Models, calibration and gates of every key of ``by`` together: one job fits all trees, Newton steps all curves."""
    y = "total_cases"
    rows = cut_lineage(matrix)
    nodes = cut_lineage(grow_each(rows, by, features, two_stage_goals(), settings))
    raw = score_each(rows, nodes, by, features, {"single": "_single", "classifier": "_odds", "normal": "_normal", "outbreak": "_outbreak"})
    scored = raw.select(
        *by, y, (F.col(y) >= F.col("outbreak_threshold")).cast("int").alias("_high"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_odds")))).alias("_raw"),
        F.coalesce("_normal", "_single").alias("_normal"), F.coalesce("_outbreak", "_single").alias("_outbreak"),
    )
    scored = cut_lineage(scored)
    curves = ML.calibration_curves(scored, by, "_raw", "_high")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("slope") * F.col("_raw") + F.col("intercept"))))
    judged = scored.join(curves, by).withColumn("_p", F.coalesce(p, F.col("_raw")))
    gates = P.policy_gates(judged, by, "_p", "_high", y, "_outbreak", "_normal")
    return TwoStage(by, features, nodes, cut_lineage(curves.join(gates, by).select(*by, F.coalesce("slope", F.lit(0.0)).alias("slope"), *POLICY[1:])))


def evaluate_expanding(
    cases: DataFrame,
    series: list[str],
    weather: list[str],
    folds: int = 4,
    settings: ML.TreeSettings = ML.TreeSettings(),
    minimum_weeks: int = 50,
) -> DataFrame:
    """Held-out predictions of all folds and series: single-stage and both two-stage policies.

    Every series and fold has models of its own, fitted on its training rows only; all are fitted together.
    """
    by = [*series, "validation_year"]
    table, base = fold_features(cases, series, weather, folds, minimum_weeks=minimum_weeks)
    table = cut_lineage(table)
    fit = two_stage_fit(training_matrix(table, by, base), [*base, *CASE_HISTORY], by, settings)
    rows = table.join(fit.curves, by)
    carry = [WEEK, "year", "weekofyear", "total_cases", "outbreak_threshold"]
    predicted = recursive_forecast(rows, by, [*base, *POLICY], two_stage_step(len(base)), COURSES, carry, TWO_STAGE_OUTPUTS, fit.nodes)
    whole = cut_lineage(predicted).join(fit.curves.select(*by, "mae_gate", "recall_gate"), by)
    return whole.withColumn("actual_outbreak", F.col("total_cases") >= F.col("outbreak_threshold"))


MODEL_COLUMNS = {
    "Single-stage": "single_stage_prediction",
    "Two-stage MAE policy": "two_stage_mae_prediction",
    "Two-stage recall policy": "two_stage_recall_prediction",
}


def summarize_alerts(predictions: DataFrame) -> DataFrame:
    """Precision, recall, PR-AUC and Brier score of both alert policies."""
    long = predictions.select(
        "actual_outbreak",
        "outbreak_probability",
        F.col("mae_policy_alert").cast("int").alias("MAE-focused policy"),
        F.col("recall_policy_alert").cast("int").alias("Recall-focused policy"),
    ).unpivot(
        ["actual_outbreak", "outbreak_probability"], ["MAE-focused policy", "Recall-focused policy"], "policy", "alert"
    )
    counts = M.confusion(long, ["policy"], "alert").select("policy", "precision", "recall")
    pr = M.average_precision(long, ["policy"], "outbreak_probability", "actual_outbreak")
    return counts.join(pr, "policy").join(M.brier(long, ["policy"], "outbreak_probability", "actual_outbreak"), "policy")


def surge_experiment(
    frame: DataFrame,
    series: list[str],
    periods: dict[str, str],
    features: list[str] | None = None,
    settings: ML.TreeSettings = ML.TreeSettings(),
    validation_years: int = 4,
) -> DataFrame:
    """The recent-case forecaster on several periods, each up to its last week, side by side.

    No period needs another's models and a boosting step keeps few cores busy, so all periods are fitted at once.
    """
    features = features or S.EXACT_FEATURES

    def report(label: str) -> DataFrame:
        rows = frame.filter(F.col(WEEK) <= F.lit(periods[label]).cast("date"))
        fitted = quantile_forecaster(
            rows, features, series, label, "cases_lag_1", validation_years, settings, fallback=True,
            minimum_labelled_years=3,
        )
        return fitted.metrics.withColumn("period", F.lit(label))

    shared_folder(frame.sparkSession)  # named before the threads ask for it
    with ThreadPoolExecutor(max(1, len(periods))) as pool:
        fits = [pool.submit(inheritable_thread_target(frame.sparkSession)(report), label) for label in periods]
        return union_parts([fit.result() for fit in fits])


def what_if_rows(
    scenarios: DataFrame, medians: DataFrame, series: list[str], weather: list[str], features: list[str]
) -> DataFrame:
    """Scenario table to model-ready rows.

    A scenario gives a week, one value per weather field, the last 8 counts and last year's
    count; everything else takes the series' training median.
    """
    c = F.col("last_8_cases")
    at = lambda k: F.element_at(c, -k).cast("double")
    mean = lambda k: F.aggregate(F.slice(c, -k, k), F.lit(0.0), lambda a, x: a + x) / F.lit(float(k))
    made = dict(harmonics("weekofyear"))
    for name in weather:
        made[f"{name}_chosen_lag"] = F.col(name).cast("double")
        made[f"{name}_mean_4"] = F.col(name).cast("double")
        made[f"{name}_missing"] = F.lit(0.0)
    made |= {
        "cases_lag_1": at(1),
        "cases_lag_2": at(2),
        "cases_lag_4": at(4),
        "cases_lag_52": F.col("cases_last_year").cast("double"),
        "cases_mean_4": mean(4),
        "cases_mean_8": mean(8),
        "cases_change_1": at(1) - at(2),
    }
    known = medians.select(*series, *[F.col(m).alias(f"_med_{m}") for m in medians.columns if m not in series])
    joined = scenarios.join(known, series, "left")
    out = []
    for name in features:
        median = F.col(f"_med_{name}") if f"_med_{name}" in joined.columns else F.lit(None).cast("double")
        out.append(F.coalesce(made.get(name, F.lit(None).cast("double")), median, F.lit(0.0)).alias(name))
    return joined.select(*[x for x in scenarios.columns if x not in features], *out)
