"""Seasonal thresholds from nearby weeks, and outbreak labels from earlier years only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import CYCLE_WEEKS, neighbour_weeks

NEAR, OUTBREAK = 0.60, 0.75


def seasonal_neighbours(
    cases: DataFrame, keys: list[str], width: int = 2, value: str = "total_cases"
) -> DataFrame:
    """Each row once for every week number it is a neighbour of: an equi-join key, not a range join."""
    return cases.select(
        *keys,
        F.col("year").alias("history_year"),
        F.col("weekofyear").alias("history_week"),
        F.explode(neighbour_weeks("weekofyear", width)).alias("weekofyear"),
        F.col(value).cast("double").alias(value),
    )


def seasonal_thresholds(
    cases: DataFrame, keys: list[str], width: int = 2, value: str = "total_cases"
) -> DataFrame:
    """q60 and q75 for week numbers 1..53 of each series, overall quantiles where no week is near."""
    near = (
        seasonal_neighbours(cases, keys, width, value)
        .groupBy(*keys, "weekofyear")
        .agg(F.percentile(value, F.array(F.lit(NEAR), F.lit(OUTBREAK))).alias("_near"))
    )
    overall = cases.groupBy(*keys).agg(
        F.percentile(F.col(value).cast("double"), F.array(F.lit(NEAR), F.lit(OUTBREAK))).alias("_all")
    )
    grid = overall.select(
        *keys, "_all", F.explode(F.sequence(F.lit(1), F.lit(CYCLE_WEEKS))).alias("weekofyear")
    )
    return grid.join(near, [*keys, "weekofyear"], "left").select(
        *keys,
        "weekofyear",
        F.coalesce(F.col("_near")[0], F.col("_all")[0]).alias("near_outbreak_threshold"),
        F.coalesce(F.col("_near")[1], F.col("_all")[1]).alias("outbreak_threshold"),
    )


def expanding_outbreak_labels(
    cases: DataFrame, keys: list[str], minimum_prior_years: int = 3, width: int = 2, value: str = "total_cases"
) -> DataFrame:
    """Label each week against the q75 of nearby weeks of strictly earlier years.

    Range frames over the year see just the earlier years: one window over a series for the
    overall quantiles and the count of earlier years, one over (series, week slot) after
    copying every row to its neighbour weeks. No year loop, no join, one pass over ``cases``.
    A group is at most a series, that is a few thousand weeks.
    """
    v = F.col(value).cast("double")
    points = F.array(F.lit(NEAR), F.lit(OUTBREAK))
    years = Window.partitionBy(*keys).orderBy("year")
    before = years.rangeBetween(Window.unboundedPreceding, -1)
    known = cases.select(
        "*", (F.dense_rank().over(years) - 1).alias("_prior_years"), F.percentile(v, points).over(before).alias("_all")
    )
    slot = Window.partitionBy(*keys, "_slot").orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    steps = F.array(*[F.lit(d) for d in range(-width, width + 1)])
    copied = known.select("*", F.explode(steps).alias("_step")).withColumn(
        "_slot", (F.pmod(F.col("weekofyear") + F.col("_step") - 1, F.lit(CYCLE_WEEKS)) + 1).cast("int")
    )
    near = copied.select("*", F.percentile(v, points).over(slot).alias("_near"))
    own = near.filter((F.col("_step") == 0) & (F.col("_prior_years") >= minimum_prior_years))
    threshold = F.coalesce(F.col("_near")[1], F.col("_all")[1])
    return own.select(
        *[F.col(c) for c in cases.columns],
        F.coalesce(F.col("_near")[0], F.col("_all")[0]).alias("near_outbreak_threshold"),
        threshold.alias("outbreak_threshold"),
        (F.col(value) >= threshold).cast("int").alias("outbreak_label"),
    )


def attach_thresholds(df: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Many weeks to one threshold row."""
    return df.join(thresholds, [*keys, "weekofyear"], "left")


def threshold_for_week(thresholds: DataFrame, weeks: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold shown beside an alert of a given week number."""
    return weeks.join(
        thresholds.select(*keys, "weekofyear", F.col("outbreak_threshold").alias("historical_outbreak_threshold_cases")),
        [*keys, "weekofyear"],
        "left",
    )
