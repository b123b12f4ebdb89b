"""Expanding time folds as one tagged table instead of one copy per loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.metrics import complete_years


def fold_years(cases: DataFrame, keys: list[str], folds: int = 4, minimum_weeks: int = 50) -> DataFrame:
    """The last ``folds`` complete years of each series that have an earlier year."""
    years = complete_years(cases, keys, minimum_weeks)
    first = cases.groupBy(*keys).agg(F.min("year").alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.col("year").desc())  # a few dozen years per series
    return (
        years.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= folds)
        .join(first, keys)
        .filter("year > _first")
        .select(*keys, F.col("year").alias("validation_year"))
    )


def inner_fold_years(cases: DataFrame, keys: list[str], splits: int = 3, reserve: int = 3) -> DataFrame:
    """The last min(splits, years - reserve) years of a series, for choices inside training."""
    years = cases.select(*keys, "year").distinct()
    w = Window.partitionBy(*keys)
    ranked = years.select(
        *keys,
        "year",
        F.row_number().over(w.orderBy(F.col("year").desc())).alias("_rn"),
        F.count(F.lit(1)).over(w).alias("_n"),
    )
    return ranked.filter(F.col("_rn") <= F.least(F.lit(splits), F.col("_n") - reserve)).select(
        *keys, F.col("year").alias("validation_year")
    )


def tag_folds(cases: DataFrame, years: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once per fold that uses it: earlier years train, the fold's year validates."""
    joined = cases.join(years, keys).filter(F.col("year") <= F.col("validation_year"))
    return joined.withColumn(
        "fold_role", F.when(F.col("year") < F.col("validation_year"), "train").otherwise("validation")
    )


def expanding_splits(cases: DataFrame, keys: list[str], folds: int = 4, minimum_weeks: int = 50) -> DataFrame:
    return tag_folds(cases, fold_years(cases, keys, folds, minimum_weeks), keys)


def inner_splits(cases: DataFrame, keys: list[str], splits: int = 3) -> DataFrame:
    return tag_folds(cases, inner_fold_years(cases, keys, splits), keys)
