"""Calendar spines: every day or week between a series' first and last one.

The gap after each row is expanded up to the next row of its series, so the input is read
once and never joined with itself. A series holds one row per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}


def _expanded(df: DataFrame, keys: list[str], day: str, step: str) -> DataFrame:
    """Each row followed by the absent steps after it; ``_step_day`` is the calendar day."""
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    last = F.coalesce(F.date_sub("_next", 1), F.col(day))
    return df.withColumn("_next", following).withColumn(
        "_step_day", F.explode(F.sequence(F.col(day), last, F.expr(STEPS[step])))
    )


def spine(df: DataFrame, keys: list[str], day: str, step: str = "day", zero: list[str] | None = None) -> DataFrame:
    """All steps of each series. Columns in ``zero`` read 0 on absent steps; others are NULL."""
    fill = set(zero or [])
    real = F.col("_step_day") == F.col(day)

    def value(name: str, kind: str):
        if name in keys:
            return F.col(name)
        if name == day:
            return F.col("_step_day").alias(day)
        if name in fill:
            return F.when(real, F.coalesce(F.col(name), F.lit(0).cast(kind))).otherwise(F.lit(0).cast(kind)).alias(name)
        return F.when(real, F.col(name)).alias(name)

    return _expanded(df, keys, day, step).select(*[value(c, t) for c, t in df.dtypes])


def missing_steps(df: DataFrame, keys: list[str], day: str, step: str = "week") -> DataFrame:
    """Calendar steps without a row."""
    filler = _expanded(df.select(*keys, day), keys, day, step).filter(F.col("_step_day") != F.col(day))
    return filler.select(*keys, F.col("_step_day").alias(day))


def calendar(df: DataFrame, keys: list[str], day: str, step: str = "day") -> DataFrame:
    """All calendar steps of each series."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    return span.select(*keys, F.explode(F.sequence("_first", "_last", F.expr(STEPS[step]))).alias(day))


def calendar_except(df: DataFrame, keys: list[str], day: str, step: str = "week") -> DataFrame:
    """Missing steps as a set difference; reads the input twice, so meant for stored tables."""
    return calendar(df, keys, day, step).subtract(df.select(*keys, day))
