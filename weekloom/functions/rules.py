"""Decision rules as expressions: rates, risk, freshness, routing and quantile order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekloom.schemas import RELIABILITY


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Ratio that is 0 when undefined."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def hospital_rate(hospital: Column, cases: Column, mode: str = "training") -> Column:
    """Hospitalizations per case.

    ``training``: 0 when both are 0, NULL when only the cases are 0.
    ``live``: 0 whenever the cases are 0.
    """
    if mode == "live":
        return F.when(cases == 0, F.lit(0.0)).otherwise(hospital / cases)
    return F.when(cases != 0, hospital / cases).when((cases == 0) & (hospital == 0), F.lit(0.0))


def risk_level(p50: Column, p80: Column, p90: Column, threshold: Column) -> Column:
    return (
        F.when(p50 >= threshold, "expected_above_threshold")
        .when(p80 >= threshold, "elevated_upper_range")
        .when(p90 >= threshold, "possible_upper_tail")
        .otherwise("below_threshold_range")
    )


def freshness_level(age_weeks: Column) -> Column:
    return (
        F.when(age_weeks.isNull(), "unavailable")
        .when(age_weeks <= 2, "current")
        .when(age_weeks <= 4, "delayed")
        .otherwise("stale")
    )


def ordered_quantiles(
    p50: Column,
    p80: Column,
    p90: Column,
    baseline: Column | float = 0.0,
    scales: tuple = (1.0, 1.0, 1.0),
    offsets: tuple = (0.0, 0.0),
) -> dict[str, Column]:
    """Non-negative, offset and ordered p50, p80, p90 from raw model outputs."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    s50, s80, s90 = (s if isinstance(s, Column) else F.lit(float(s)) for s in scales)
    o80, o90 = (o if isinstance(o, Column) else F.lit(float(o)) for o in offsets)
    zero = F.lit(0.0)
    low = F.greatest(zero, base + s50 * p50)
    mid = F.greatest(zero, base + s80 * p80, low, low + o80)
    return {"p50": low, "p80": mid, "p90": F.greatest(zero, base + s90 * p90, low + o90, mid)}


def two_stage_value(probability: Column, gate: Column, outbreak: Column, normal: Column) -> Column:
    return F.when(probability >= gate, outbreak).otherwise(normal)


def route_variant(has_exact: Column, has_delayed: Column) -> Column:
    """Best usable case information: exact weeks, a delayed report, or none."""
    return (
        F.when(has_exact, "weather_plus_recent_cases")
        .when(has_delayed, "weather_plus_delayed_cases")
        .otherwise("weather_only")
    )


def route_reliability(variant: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in RELIABILITY.items():
        out = F.when(variant == name, text).otherwise(out)
    return out
