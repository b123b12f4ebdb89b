"""Data-quality checks and profiles.

A check returns the offending rows as a DataFrame; ``require_empty`` turns one into an
error. Join checks run inside the join's own shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import stored_small
from weekloom.operators.ordered import table_moments, table_quantiles, unpivot, value_table


class QualityError(ValueError):
    """A data-quality rule failed."""


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise QualityError(f"missing columns: {missing}")
    return df


def column_presence(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column: whether the table has it, and how many rows fill it."""
    have = [c for c in required if c in df.columns]
    filled = df.agg(*[F.count(c).alias(c) for c in have], *[F.lit(0).cast("bigint").alias(c) for c in required if c not in have])
    return filled.unpivot([], required, "column_name", "value_count").select(
        "column_name", F.col("column_name").isin(have).alias("present"), "value_count"
    )


def require_empty(offending: DataFrame, message: str) -> None:
    sample = offending.take(5)
    if sample:
        raise QualityError(f"{message}: {sample}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise QualityError(message)
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def negative_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    return df.filter(bad)


def out_of_unit_range(df: DataFrame, column: str) -> DataFrame:
    """Rows whose probability is missing, not finite or outside [0, 1]."""
    p = F.col(column)
    return df.filter(p.isNull() | F.isnan(p) | ~p.between(0.0, 1.0))


def unexpected_values(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Values seen but not expected, and expected but not seen."""
    seen = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    want = (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(v) for v in expected])).alias(column))
        .withColumn("expected", F.lit(True))
    )
    both = seen.join(want, column, "full_outer")
    return both.select(
        column,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("expected", F.lit(False)).alias("expected"),
    ).filter(~F.col("expected") | (F.col("row_count") == 0))


def wrong_group_sizes(df: DataFrame, column: str, expected_rows: int) -> DataFrame:
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") != F.lit(expected_rows))
    )


def single_side(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The same rows, failing at run time when a key repeats.

    Counting per key shuffles on the join keys, so the join that follows reuses it.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*(rest or keys))).alias("_row")
    )
    ok = F.when(
        F.col("_n") > 1, F.raise_error(F.lit(f"{side} side of the join repeats a key of {keys}")).cast("boolean")
    ).otherwise(True)
    return packed.filter(ok).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def checked_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", expect: str = "one_to_one"
) -> DataFrame:
    """Join whose declared cardinality is enforced: one_to_one, many_to_one, one_to_many."""
    one_left, one_right = expect.split("_to_")
    if one_left == "one":
        left = single_side(left, on, "left")
    if one_right == "one":
        right = single_side(right, on, "right")
    return left.join(right, on, how)


def join_cardinality(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: the repeated keys of each side and the cardinality that holds."""
    per_key = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_l"))
        .join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")), on, "full_outer")
    )
    counted = per_key.agg(
        F.count_if(F.col("_l") > 1).alias("left_repeated_keys"),
        F.count_if(F.col("_r") > 1).alias("right_repeated_keys"),
        F.count_if(F.col("_l").isNull()).alias("right_only_keys"),
        F.count_if(F.col("_r").isNull()).alias("left_only_keys"),
    )
    many_l, many_r = F.col("left_repeated_keys") > 0, F.col("right_repeated_keys") > 0
    return counted.withColumn(
        "cardinality",
        F.concat(F.when(many_l, "many").otherwise("one"), F.lit("_to_"), F.when(many_r, "many").otherwise("one")),
    )


def row_loss(old: DataFrame, new: DataFrame, keys: list[str], allowed: float = 0.10) -> DataFrame:
    """Rows before and after per series, and whether the loss is acceptable."""
    tagged = old.select(*keys, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(
        new.select(*keys, F.lit(0).alias("_o"), F.lit(1).alias("_n"))
    )
    counts = tagged.groupBy(*keys).agg(F.sum("_o").alias("old_rows"), F.sum("_n").alias("new_rows"))
    return counts.withColumn(
        "accepted",
        (F.col("old_rows") == 0) | (F.col("new_rows") >= F.lit(1.0 - allowed) * F.col("old_rows")),
    )


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_count")


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def date_ranges(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last day of each named source."""
    parts = [
        df.agg(F.min(c).cast("date").alias("first_day"), F.max(c).cast("date").alias("last_day")).select(
            F.lit(name).alias("source"), "first_day", "last_day"
        )
        for name, (df, c) in sources.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def describe(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of each column's finite values.

    The rows are read once, into a table of distinct values with their counts, from which all else follows.
    """
    keys = keys or []
    by = [*keys, "column_name"]
    counted = value_table(unpivot(df, keys, columns, "column_name", "_value"), by, "_value")
    quartiles = table_quantiles(counted, by, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    found = table_moments(counted, by)
    same = F.lit(True)
    for c in by:
        same = same & found[c].eqNullSafe(quartiles[c])
    return found.join(quartiles, same, "left").select(*[found[c] for c in found.columns], "p25", "p50", "p75")


def outlier_counts(df: DataFrame, column: str, keys: list[str] | None = None, deviations: float = 2.0) -> DataFrame:
    """Rows above mean + ``deviations`` sample deviations."""
    keys = keys or []
    limits = stored_small(
        df.groupBy(*keys).agg((F.avg(column) + F.lit(deviations) * F.stddev_samp(column)).alias("upper_limit"))
    )
    if keys:
        joined = df.select(*keys, column).join(limits, keys)
    else:
        joined = df.select(column).crossJoin(F.broadcast(limits))  # one row
    return joined.groupBy(*keys, "upper_limit").agg(
        F.count_if(F.col(column) > F.col("upper_limit")).alias("outlier_count")
    )


