"""Final models on the whole history of every series: fit, save, reload, score scenarios.

Every series has models of its own. They are rows: a node table keyed (series, version, tree, node), medians, chosen
lags, thresholds, curves and facts keyed (series, version). Scoring joins a series' rows with its nodes, so no
driver ever holds the models of all series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import cut_lineage
from weekloom.operators import forecast as W
from weekloom.operators.boosting import Goal, grow_each, score_each
from weekloom.operators.quality import QualityError
from weekloom.operators.recursion import CASE_HISTORY
from weekloom.operators.thresholds import seasonal_thresholds
from weekloom.operators.trees import TreeSettings

WEEK = "week_start_date"
TABLES = ("nodes", "medians", "lags", "thresholds", "curves", "facts")


@dataclass
class FinalModels:
    """Tables of the fitted models; ``curves`` is None for the single stage. Medians are long: (series, feature, median, position)."""

    series: list[str]
    weather: list[str]
    nodes: DataFrame
    medians: DataFrame
    lags: DataFrame
    thresholds: DataFrame
    curves: DataFrame | None
    facts: DataFrame

    @property
    def features(self) -> list[str]:
        return feature_names(self.weather)


def feature_names(weather: list[str]) -> list[str]:
    names = [f"week_{fn}_{h}" for h in (1, 2) for fn in ("sin", "cos")]
    for c in weather:
        names += [f"{c}_chosen_lag", f"{c}_mean_4", f"{c}_missing"]
    return [*names, *CASE_HISTORY]


def final_matrix(cases: DataFrame, series: list[str], weather: list[str], maximum_lag: int = 12) -> tuple[DataFrame, DataFrame]:
    """Training rows of the whole history, gaps filled from the past and with medians, and the lags chosen."""
    shaped, base, lags = W.shaped_features(cases.withColumn("fold_role", F.lit("train")), series, weather, maximum_lag)
    return cut_lineage(W.training_matrix(cut_lineage(shaped), series, base)), lags


def _tables(matrix: DataFrame, lags: DataFrame, series: list[str], weather: list[str], nodes: DataFrame, curves: DataFrame | None) -> FinalModels:
    names = feature_names(weather)
    wide = matrix.groupBy(*series).agg(*[F.median(c).alias(c) for c in names])
    y, high = F.col("total_cases"), F.col("total_cases") >= F.col("outbreak_threshold")
    facts = matrix.groupBy(*series).agg(
        F.count(F.lit(1)).alias("training_rows"), F.min(WEEK).alias("training_start"), F.max(WEEK).alias("training_end"),
        F.median(y).alias("median_cases"), F.count_if(high).alias("outbreak_rows"),
        F.count_if(y >= F.col("near_outbreak_threshold")).alias("near_outbreak_rows"),
    )
    places = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    medians = wide.unpivot(series, names, "feature", "median").withColumn("position", places[F.col("feature")])
    return FinalModels(series, weather, nodes, medians, lags, seasonal_thresholds(matrix, series), curves, facts)


def single_stage_fit(
    cases: DataFrame, series: list[str], weather: list[str], settings: TreeSettings = TreeSettings(), maximum_lag: int = 12
) -> FinalModels:
    """One case model for every series, fitted on all its weeks."""
    matrix, lags = final_matrix(cases, series, weather, maximum_lag)
    nodes = cut_lineage(grow_each(matrix, series, feature_names(weather), [Goal("single", F.col("total_cases"), F.lit(1.0))], settings))
    return _tables(matrix, lags, series, weather, nodes, None)


def two_stage_final(
    cases: DataFrame, series: list[str], weather: list[str], settings: TreeSettings = TreeSettings(), maximum_lag: int = 12
) -> FinalModels:
    """Single stage, classifier with curve and gates, and both specialists for every series, fitted on all its weeks."""
    matrix, lags = final_matrix(cases, series, weather, maximum_lag)
    fit = W.two_stage_fit(matrix, feature_names(weather), series, settings)
    return _tables(matrix, lags, series, weather, fit.nodes, fit.curves)


def save_final(models: FinalModels, path: str, version: str) -> None:
    """Every table as a partition of ``version``; saving a version again replaces it. ``facts`` is written last."""
    for name in TABLES:
        table = getattr(models, name)
        if table is not None:
            out = table.withColumn("version", F.lit(version)).write.mode("overwrite").partitionBy("version")
            out.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def load_final(spark: SparkSession, path: str, version: str, series: list[str]) -> FinalModels:
    """The tables of one version; nothing is read until rows are scored."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").where(F.col("version") == version).drop("version")

    facts = read("facts")
    if facts.isEmpty():
        raise QualityError(f"no saved models of version {version}")
    # Feature names in the order that the nodes number them.
    names = [r["feature"] for r in read("medians").select("position", "feature").distinct().orderBy("position").collect()]
    weather = [n.removesuffix("_chosen_lag") for n in names if n.endswith("_chosen_lag")]
    two_stage = not read("nodes").where("tag = 'classifier'").isEmpty()
    return FinalModels(series, weather, read("nodes"), read("medians"), read("lags"), read("thresholds"), read("curves") if two_stage else None, facts)


def scenario_rows(models: FinalModels, scenarios: DataFrame) -> DataFrame:
    """Model-ready rows of what-if scenarios; what a scenario leaves open takes the series' training median."""
    wide = models.medians.groupBy(*models.series).pivot("feature", models.features).agg(F.first("median"))
    return W.what_if_rows(scenarios, wide, models.series, models.weather, models.features)


def score_scenarios(models: FinalModels, rows: DataFrame) -> DataFrame:
    """``rows`` (model-ready) with the single-stage prediction and, for two-stage models, probability, alerts and both policies."""
    tags = {"single": "_single"} | ({"classifier": "_odds", "normal": "_normal", "outbreak": "_outbreak"} if models.curves is not None else {})
    scored = score_each(rows, models.nodes, models.series, models.features, tags)
    floor = lambda c: F.greatest(F.lit(0.0), c)
    single = floor(F.col("_single")).alias("single_stage_prediction")
    if models.curves is None:
        return scored.select(*rows.columns, single)
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_odds")))
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("slope") * raw + F.col("intercept"))))
    p = F.when(F.col("slope") == 0, raw).otherwise(curve)
    judged = scored.join(models.curves, models.series, "left").withColumn("_p", p)
    normal, outbreak = (floor(F.coalesce(c, "_single")) for c in ("_normal", "_outbreak"))
    alerts = [(F.col("_p") >= F.col(g)).alias(a) for g, a in (("mae_gate", "mae_policy_alert"), ("recall_gate", "recall_policy_alert"))]
    values = [F.when(F.col("_p") >= F.col(g), outbreak).otherwise(normal).alias(n) for g, n in (
        ("mae_gate", "two_stage_mae_prediction"), ("recall_gate", "two_stage_recall_prediction"))]
    return judged.select(*rows.columns, single, F.col("_p").alias("outbreak_probability"), *alerts, *values)
