"""Learners with the settings of the weekly programs, on pooled series.

One model serves all series, told apart by numbers from their own past. All are boosted trees of
``operators.boosting``. The driver holds model parameters and year numbers only, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import cut_lineage, stored_small
from weekloom.operators.boosting import Goal, grow
from weekloom.operators.metrics import class_weights
from weekloom.operators.trees import (  # noqa: F401  the names that callers use
    NODE_SCHEMA,
    ProbabilityModel,
    QuantileModel,
    Tree,
    TreeSettings,
    node_rows,
    trees_from_rows,
)

#: Newton steps of a calibration curve; the loss is convex and nearly quadratic.
CURVE_STEPS = 8

SERIES_FEATURES = ["series_level", "series_spread", "series_zero_share"]


def series_features(df: DataFrame, series: list[str], value: str = "total_cases", week: str = "week_start_date") -> DataFrame:
    """Level, spread and share of zero weeks of each series' earlier weeks: what tells series apart, for any number of them."""
    past = Window.partitionBy(*series).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value).cast("double")
    made = (F.avg(v), F.stddev_samp(v), F.avg((v == 0).cast("double")))
    return df.select("*", *[F.coalesce(m.over(past), F.lit(0.0)).alias(n) for n, m in zip(SERIES_FEATURES, made, strict=True)])


def series_constants(train: DataFrame, by: list[str], value: str = "total_cases") -> DataFrame:
    """The same three numbers over all training rows of each key of ``by``."""
    v = F.col(value).cast("double")
    made = (F.avg(v), F.stddev_samp(v), F.avg((v == 0).cast("double")))
    return train.groupBy(*by).agg(*[F.coalesce(m, F.lit(0.0)).alias(n) for n, m in zip(SERIES_FEATURES, made, strict=True)])


def outbreak_classifier(
    train: DataFrame, features: list[str], label: str, settings: TreeSettings, weight: str | None = None
) -> ProbabilityModel:
    goal = Goal("p", F.col(label).cast("double"), F.col(weight) if weight else F.lit(1.0), None)
    return grow(train, features, [goal], settings)["p"]


def predict_probability(model: ProbabilityModel, df: DataFrame, features: list[str], name: str) -> DataFrame:
    return df.select("*", model.column(features).alias(name))


@dataclass(frozen=True)
class Calibrator:
    """Logistic curve over the raw probability, or the identity when fitted on one class."""

    slope: float | None = None
    intercept: float = 0.0

    def apply(self, raw: Column) -> Column:
        if self.slope is None:
            return raw
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * raw + F.lit(self.intercept))))


def calibration_curves(df: DataFrame, keys: list[str], raw: str, label: str, steps: int = CURVE_STEPS) -> DataFrame:
    """(keys, slope, intercept) of the Platt curves of all keys together, by Newton steps on grouped sums.

    Minimizes the summed log loss and half the squared slope. A step is one aggregate over the rows; a key with one
    class only has a null slope, which stands for the identity.
    """
    rows = df.select(*keys, F.col(raw).cast("double").alias("_r"), F.col(label).cast("double").alias("_y")).dropna(subset=["_r", "_y"])
    rows = cut_lineage(rows.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_ones")))
    whole = rows.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum("_ones").alias("_pos"))
    curves = whole.select(*keys, F.when((F.col("_pos") > 0) & (F.col("_pos") < F.col("_all")), 0.0).alias("slope"), F.lit(0.0).alias("intercept"))
    a, b, r, n = F.col("slope"), F.col("intercept"), F.col("_r"), F.col("_n")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(a * r + b)))
    for _ in range(steps):
        known = stored_small(curves)
        at = (rows.join(known, keys) if keys else rows.join(F.broadcast(known))).withColumn("_p", p)
        miss, curve = n * F.col("_p") - F.col("_ones"), n * F.col("_p") * (1 - F.col("_p"))
        sums = at.groupBy(*keys, "slope", "intercept").agg(
            F.sum(miss * r).alias("ga"), F.sum(miss).alias("gb"), F.sum(curve * r * r).alias("aa"), F.sum(curve * r).alias("ab"), F.sum(curve).alias("bb")
        )
        ga, aa = F.col("ga") + a, F.col("aa") + 1.0
        gb, ab, bb = F.col("gb"), F.col("ab"), F.col("bb")
        size = aa * bb - ab * ab
        curves = sums.select(
            *keys,
            (a - F.try_divide(bb * ga - ab * gb, size)).alias("slope"),
            F.when(a.isNotNull(), F.coalesce(b - F.try_divide(aa * gb - ab * ga, size), b)).otherwise(0.0).alias("intercept"),
        )
    return stored_small(curves)


def probability_calibrator(df: DataFrame, raw: str, label: str) -> Calibrator:
    """Platt scaling over all rows."""
    found = calibration_curves(df, [], raw, label).first()
    return Calibrator(found["slope"], found["intercept"]) if found and found["slope"] is not None else Calibrator()


def quantile_regressor(
    train: DataFrame, features: list[str], label: str, quantile: float, settings: TreeSettings, weight: str | None = None
) -> QuantileModel:
    """Pinball-loss boosting; ``weight`` names a column of whole numbers: a row counts that often."""
    goal = Goal("q", F.col(label), F.col(weight) if weight else F.lit(1.0), float(quantile))
    return grow(train, features, [goal], settings)["q"]


def point_regressor(
    train: DataFrame, features: list[str], label: str, settings: TreeSettings, weight: str | None = None
) -> QuantileModel:
    """Absolute-error boosted trees: the boosting above for the median."""
    return quantile_regressor(train, features, label, 0.5, settings, weight)


def predict_point(model: QuantileModel, df: DataFrame, features: list[str], name: str, floor: float | None = 0.0) -> DataFrame:
    value = model.column(features)
    return df.select("*", (value if floor is None else F.greatest(F.lit(floor), value)).alias(name))


def balanced(train: DataFrame, label: str) -> DataFrame:
    return class_weights(train, [], label, "_weight")


def years_of(df: DataFrame, year: str = "year") -> list[int]:
    """Distinct years, a few dozen numbers."""
    return sorted(r[0] for r in df.select(year).distinct().collect())
