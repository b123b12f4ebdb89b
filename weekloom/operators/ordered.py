"""Running totals and exact quantiles that never sort one group in one task.

Rows are first counted per distinct value, then cut into value ranges that hold about
equal shares of all rows. A (group, range) pair therefore stays small even when one group
owns most of the table; only the range totals, at most ``ranges`` rows per group, are
ordered as a whole.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import stored_small
from weekloom.functions.cleaning import finite

#: Distinct values that a range may hold; their number sets the number of ranges.
RANGE_VALUES = 20_000
LEAST_RANGES, MOST_RANGES = 8, 4096


def range_splits(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Cut points of about equal depth, one for each ``RANGE_VALUES`` rows of ``df`` (a bounded driver result)."""
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, df.count() // RANGE_VALUES))
    points = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(value, points, 1.0 / ranges)
    return [float("-inf"), *sorted(set(found)), float("inf")]


def with_range(df: DataFrame, value: str, splits: list[float], name: str) -> DataFrame:
    """Add the index of the value range; a value on a cut belongs to the range it opens."""
    if len(splits) < 3:  # one range: an empty table or a single value
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=name).transform(df)


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    totals: list[str],
    descending: bool = False,
    splits: list[float] | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` in order of ``value``; one row per key and value.

    ``df`` holds one row per (keys, value).
    """
    splits = splits or range_splits(df, value)
    ranged = with_range(df, value, splits, "_range")
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        ranged.groupBy(*keys, "_range")
        .agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
        .select(
            *keys,
            "_range",
            *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in totals],
        )
    )
    inner_order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(inner_order).rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(f"_w_{c}") for c in totals])
    joined = _null_safe_join(summed, heads, [*keys, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"cum_{c}") for c in totals])


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, cond, "left")


def value_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _n): every distinct finite value with its number of rows, stored; what follows reads this, not the rows."""
    present = df.select(*keys, finite(value).alias("_v")).filter(F.col("_v").isNotNull())
    return stored_small(present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "values")


def table_moments(counted: DataFrame, keys: list[str]) -> DataFrame:
    """value_count, mean, std (sample), min and max of a value table; squares are centred before they are added."""
    n, v = F.col("_n"), F.col("_v")
    first = counted.groupBy(*keys).agg(
        F.sum(n).alias("value_count"), (F.sum(n * v) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    joined = _null_safe_join(counted, stored_small(first.select(*keys, "mean")), keys)
    gap = v - F.col("mean")
    spread = joined.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(n * gap * gap), F.sum(n) - 1)).alias("std"))
    return _null_safe_join(first, spread, keys).select(*keys, "value_count", "mean", "std", "min", "max")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: dict[str, float],
    splits: list[float] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key; one output column per named point.

    NaN and infinities are no values.
    """
    return table_quantiles(value_table(df, keys, value), keys, points, splits)


def table_quantiles(counted: DataFrame, keys: list[str], points: dict[str, float], splits: list[float] | None = None) -> DataFrame:
    """``exact_quantiles`` from a value table; ranges hold about equal numbers of distinct values."""
    placed = running_totals(counted, keys, "_v", ["_n"], splits=splits)
    size = stored_small(counted.groupBy(*keys).agg(F.sum("_n").alias("_size")))
    placed = _null_safe_join(placed, size, keys) if keys else placed.join(F.broadcast(size))  # one row
    ends = F.col("cum__n")
    starts = ends - F.col("_n")
    picks = []
    for name, q in points.items():
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((starts <= rank) & (rank < ends), F.col("_v"))).alias(f"_{tag}_{name}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
            for n in points
        ],
    )


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Long form of numeric columns."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keys, columns, name, value)
