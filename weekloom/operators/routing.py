"""Choose the best usable case information of each target week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.functions.rules import route_reliability, route_variant
from weekloom.operators.features import WEEK, live_delayed_features, live_exact_features


def route_targets(
    targets: DataFrame, history: DataFrame, keys: list[str], minimum_age: int = 4, maximum_age: int = 12
) -> DataFrame:
    """Targets with exact and delayed features where they exist, and the route that follows.

    Exact weeks beat a delayed report, which beats weather alone. ``targets`` holds one row
    per series and week.
    """
    exact = live_exact_features(history, targets, keys).withColumn("_exact", F.lit(True))
    delayed = live_delayed_features(history, targets, keys, minimum_age, maximum_age).withColumn("_delayed", F.lit(True))
    joined = targets.join(exact, [*keys, WEEK], "left").join(
        delayed.withColumnRenamed("case_report_anchor_week", "_anchor"), [*keys, WEEK], "left"
    )
    variant = route_variant(F.coalesce("_exact", F.lit(False)), F.coalesce("_delayed", F.lit(False)))
    routed = joined.withColumn("model_variant", variant)
    on = lambda name, value: F.when(F.col("model_variant") == name, value)
    exact_name, delayed_name = "weather_plus_recent_cases", "weather_plus_delayed_cases"
    return routed.select(
        *targets.columns,
        *S.EXACT_FEATURES,
        *S.DELAYED_FEATURES,
        "model_variant",
        route_reliability(F.col("model_variant")).alias("case_forecast_reliability"),
        F.coalesce(on(exact_name, F.date_sub(WEEK, 7)), on(delayed_name, F.col("_anchor"))).alias("case_report_anchor_week"),
        F.coalesce(on(exact_name, F.lit(1.0)), on(delayed_name, F.col("report_age_weeks"))).alias("case_report_age_weeks"),
    )
