"""Joins and unions that carry a meaning of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.quality import checked_join


def features_with_labels(features: DataFrame, labels: DataFrame, on: list[str], target: str = "total_cases") -> DataFrame:
    """One-to-one inner join of features and labels."""
    return checked_join(features, labels.select(*on, target), on, "inner", "one_to_one")


def lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left many-to-one join; whether the table is broadcast is left to its measured size."""
    return checked_join(df, table, on, "left", "many_to_one")


def fan_out(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left one-to-many join."""
    return checked_join(df, table, on, "left", "one_to_many")


def union_tagged(parts: dict[str, DataFrame], tag: str = "partition") -> DataFrame:
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_parts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
