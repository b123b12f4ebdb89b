"""Forecast and alert metrics per group, all as partial aggregates before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import stored_small
from weekloom.functions.rules import safe_ratio
from weekloom.operators.ordered import exact_quantiles, running_totals


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    gap = actual - predicted
    return F.greatest(F.lit(q) * gap, F.lit(q - 1.0) * gap)


def mae_split(
    df: DataFrame,
    keys: list[str],
    actual: str = "actual_cases",
    predicted: str = "predicted_cases_p50",
    outbreak: str = "actual_outbreak",
    persistence: str | None = "cases_lag_1",
    weekly_groups: bool = False,
) -> DataFrame:
    """MAE and median absolute error overall, MAE of normal and outbreak weeks and of persistence.

    ``weekly_groups`` says that a group is the weeks of one series; then the built-in median
    joins the same aggregate. Otherwise the median comes from value ranges.
    """
    error = F.abs(_c(actual) - _c(predicted))
    high = F.col(outbreak).cast("int") == 1
    aggs = [
        F.count(F.lit(1)).alias("held_out_rows"),
        F.avg(error).alias("mae"),
        F.avg(F.when(~high, error)).alias("normal_week_mae"),
        F.avg(F.when(high, error)).alias("outbreak_week_mae"),
    ]
    if persistence:
        aggs.append(F.avg(F.abs(_c(actual) - _c(persistence))).alias("persistence_mae"))
    if weekly_groups:
        return df.groupBy(*keys).agg(*aggs, F.median(error).alias("median_absolute_error"))
    means = df.groupBy(*keys).agg(*aggs)
    middle = exact_quantiles(df.select(*keys, error.alias("_e")), keys, "_e", {"median_absolute_error": 0.5})
    return means.join(middle, keys, "left") if keys else means.crossJoin(F.broadcast(middle))


def model_mae(
    df: DataFrame, models: dict[str, str], series: str, actual: str = "total_cases", outbreak: str = "actual_outbreak"
) -> DataFrame:
    """MAE of several prediction columns, overall and per series, in one pass."""
    long = df.select(
        series,
        _c(actual).alias("_a"),
        F.col(outbreak).cast("int").alias("_o"),
        *[_c(c).alias(name) for name, c in models.items()],
    ).unpivot([series, "_a", "_o"], list(models), "model", "_p")
    error = F.abs(F.col("_a") - F.col("_p"))
    return (
        long.groupingSets([["model"], ["model", series]], "model", series)
        .agg(
            F.avg(error).alias("mae"),
            F.avg(F.when(F.col("_o") == 0, error)).alias("normal_week_mae"),
            F.avg(F.when(F.col("_o") == 1, error)).alias("outbreak_week_mae"),
        )
        .select("model", F.coalesce(series, F.lit("overall")).alias(series), "mae", "normal_week_mae", "outbreak_week_mae")
    )


def pinball_coverage(
    df: DataFrame, keys: list[str], actual: str = "actual_cases", prefix: str = "predicted_cases"
) -> DataFrame:
    a = _c(actual)
    aggs = []
    for q, tag in ((0.80, "p80"), (0.90, "p90")):
        p = _c(f"{prefix}_{tag}")
        aggs.append(F.avg(pinball(a, p, q)).alias(f"{tag}_pinball_loss"))
        aggs.append(F.avg((a <= p).cast("double")).alias(f"{tag}_coverage"))
    return df.groupBy(*keys).agg(*aggs)


def confusion(df: DataFrame, keys: list[str], alert: str = "outbreak_alert", actual: str = "actual_outbreak") -> DataFrame:
    """Counts and ratios of an alert; precision and recall are 0 when undefined."""
    up, high = F.col(alert).cast("boolean"), F.col(actual).cast("int") == 1
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated_rows"),
        F.count_if(up & high).alias("true_positives"),
        F.count_if(up & ~high).alias("false_positives"),
        F.count_if(~up & ~high).alias("true_negatives"),
        F.count_if(~up & high).alias("false_negatives"),
    )
    return counted.select("*", *confusion_ratios())


def confusion_ratios() -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    return [
        ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
        (tn / F.nullif(tn + fp, F.lit(0))).alias("specificity"),
    ]


def average_precision(
    df: DataFrame,
    keys: list[str],
    score: str = "probability",
    label: str = "label",
    splits: list[float] | None = None,
) -> DataFrame:
    """Step-sum average precision; equal scores form one step; NULL when only one class exists.

    Scores are counted first and the running counts come from value ranges, so a dominant
    series is never sorted in one task.
    """
    y = F.col(label).cast("int")
    df = df.filter(F.col(score).isNotNull())
    steps = (
        df.select(*keys, _c(score).alias("_s"), y.alias("_y"))
        .groupBy(*keys, "_s")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p"))
    )
    totals = df.groupBy(*keys).agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_all"))
    run = running_totals(steps, keys, "_s", ["_n", "_p"], descending=True, splits=splits)
    # Each step adds (its positives / all positives) * precision at that score.
    gained = run.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("cum__p") / F.col("cum__n")).alias("_area"))
    joined = gained.join(totals, keys) if keys else gained.crossJoin(F.broadcast(totals))
    return joined.select(
        *keys,
        F.when((F.col("_pos") > 0) & (F.col("_pos") < F.col("_all")), F.col("_area") / F.col("_pos")).alias("pr_auc"),
    )


def brier(df: DataFrame, keys: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    gap = _c(score) - F.col(label).cast("double")
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def threshold_signal(
    df: DataFrame,
    keys: list[str],
    predicted: str = "predicted_cases_p50",
    threshold: str = "outbreak_threshold",
    actual: str = "actual_outbreak",
) -> DataFrame:
    """Precision and recall of the median forecast as an alert."""
    up, high = _c(predicted) >= _c(threshold), F.col(actual).cast("int") == 1
    hit = F.count_if(up & high)
    return df.groupBy(*keys).agg(
        safe_ratio(hit, F.count_if(up)).alias("p50_threshold_precision"),
        safe_ratio(hit, F.count_if(high)).alias("p50_threshold_recall"),
    )


def class_weights(df: DataFrame, keys: list[str], label: str = "outbreak_label", name: str = "weight") -> DataFrame:
    """Equal total weight for both classes; 1 when a class is absent.

    Counts are aggregated per key and joined back, so no group is gathered for a window.
    """
    counts = stored_small(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label).cast("int") == 1).alias("_p"))
    )
    joined = df.join(counts, keys) if keys else df.crossJoin(F.broadcast(counts))
    n, p = F.col("_n"), F.col("_p")
    both = (p > 0) & (p < n)
    weight = F.when(~both, F.lit(1.0)).when(F.col(label).cast("int") == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    return joined.withColumn(name, weight).drop("_n", "_p")


MOMENTS = ["n", "mean_x", "mean_y", "m2_x", "m2_y", "c_xy"]


def co_moments(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, MOMENTS) of the rows where both values stand: count, means, and centred sums of squares and products.

    Centred sums keep their digits whatever the size of the values, and merge: Spark adds them up per task.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    n = F.count(a)
    sums = {"n": n, "mean_x": F.avg(a), "mean_y": F.avg(b), "m2_x": n * F.var_pop(a), "m2_y": n * F.var_pop(b), "c_xy": n * F.covar_pop(a, b)}
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union of parts, for any coarser ``keys``: of years that make up a training set, say."""
    n = F.col("n")
    whole = parts.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        *[F.try_divide(F.sum(n * F.col(f"mean_{v}")), F.sum("n")).alias(f"_{v}") for v in "xy"],
    )
    joined = parts.join(stored_small(whole), keys) if keys else parts.join(F.broadcast(stored_small(whole)))
    dx, dy = F.col("mean_x") - F.col("_x"), F.col("mean_y") - F.col("_y")
    return joined.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.first("_x").alias("mean_x"), F.first("_y").alias("mean_y"),
        F.sum(F.col("m2_x") + n * dx * dx).alias("m2_x"), F.sum(F.col("m2_y") + n * dy * dy).alias("m2_y"),
        F.sum(F.col("c_xy") + n * dx * dy).alias("c_xy"),
    )


#: A sum of squares below this share of n * mean^2 is rounding: the column is constant.
FLAT = 1e-29


def moments_corr() -> Column:
    """Pearson correlation of a row of moments; NULL where a side is constant or fewer than two rows stand."""
    moves = lambda v: F.col(f"m2_{v}") > F.lit(FLAT) * F.col("n") * F.col(f"mean_{v}") * F.col(f"mean_{v}")
    ratio = F.try_divide(F.col("c_xy"), F.sqrt(F.col("m2_x")) * F.sqrt(F.col("m2_y")))
    return F.when((F.col("n") > 1) & moves("x") & moves("y"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))


def pairwise_corr(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, one pass; NULL where a column is constant."""
    keys = keys or []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    entries = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), _c(a).alias("x"), _c(b).alias("y")) for a, b in pairs])
    long = df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    names = [*keys, "left_column", "right_column"]
    return co_moments(long, names).select(*names, moments_corr().alias("correlation"))


def lag_moments(
    df: DataFrame, keys: list[str], target: str, columns: list[str], maximum_lag: int = 20, order: str = "week_start_date",
    parts: list[str] | None = None,
) -> DataFrame:
    """Moments of (field shifted by 0..maximum_lag rows, target) per key, field and lag, from one pass over the rows.

    ``parts`` are further keys, a year say, whose rows can be merged later (``merged_moments``).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    shifted = [F.array(*[_c(c) if k == 0 else F.lag(_c(c), k).over(w) for k in range(maximum_lag + 1)]).alias(c) for c in columns]
    kept = [*keys, *(parts or [])]
    wide = df.select(*kept, _c(target).alias("y"), *shifted)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("past")) for c in columns]))
    each = wide.select(*kept, "y", fields.alias("_f")).select(*kept, "y", "_f.column_name", F.posexplode("_f.past").alias("lag_weeks", "x"))
    return co_moments(each, [*kept, "column_name", "lag_weeks"])


def lag_corr(
    df: DataFrame,
    keys: list[str],
    target: str,
    columns: list[str],
    maximum_lag: int = 12,
    order: str = "week_start_date",
) -> DataFrame:
    """Correlation of the target with each column shifted 0..maximum_lag rows, and the pair count."""
    found = lag_moments(df, keys, target, columns, maximum_lag, order)
    return found.select(*keys, "column_name", "lag_weeks", moments_corr().alias("correlation"), F.col("n").alias("pairs"))


def best_lag(correlations: DataFrame, keys: list[str], minimum_pairs: int = 6, maximum_lag: int | None = None) -> DataFrame:
    """Lag of the strongest absolute correlation, up to ``maximum_lag`` where given; the shorter lag wins a tie."""
    if maximum_lag is not None:
        correlations = correlations.where(F.col("lag_weeks") <= maximum_lag)
    known = F.when(F.col("pairs") >= minimum_pairs, F.abs("correlation"))
    strength = F.coalesce(F.when(~F.isnan(known), known), F.lit(0.0))
    ranked = correlations.withColumn("_r", F.struct(strength.alias("s"), (-F.col("lag_weeks")).alias("l")))
    return (
        ranked.groupBy(*keys, "column_name")
        .agg(F.max("_r").alias("_r"))
        .select(*keys, "column_name", (-F.col("_r.l")).alias("best_lag"), F.col("_r.s").alias("best_abs_correlation"))
    )


def yearly_summary(cases: DataFrame, keys: list[str], value: str = "total_cases") -> DataFrame:
    """Weekly mean, maximum, total and count per ISO year, and the ratio to the series mean."""
    yearly = cases.groupBy(*keys, "year").agg(
        F.avg(value).alias("mean_weekly_cases"),
        F.max(value).alias("max_weekly_cases"),
        F.sum(value).alias("total_yearly_cases"),
        F.count(value).alias("weeks_reported"),
    )
    # The years of one series are few; the series mean follows from their totals.
    w = Window.partitionBy(*keys)
    overall = F.sum("total_yearly_cases").over(w) / F.sum("weeks_reported").over(w)
    return yearly.withColumn("ratio_to_series_mean", F.col("mean_weekly_cases") / overall)


def complete_years(cases: DataFrame, keys: list[str], minimum_weeks: int = 50) -> DataFrame:
    return (
        cases.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("week_count")).filter(F.col("week_count") >= minimum_weeks)
    )


def column_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact medians, long form (keys, column_name, median)."""
    from weekloom.operators.ordered import unpivot

    long = unpivot(df, keys, columns, "column_name", "_v")
    return exact_quantiles(long, [*keys, "column_name"], "_v", {"median": 0.5})


def wide_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians with one column per field, for filling."""
    long = column_medians(df, keys, columns)
    return long.groupBy(*keys).pivot("column_name", columns).agg(F.first("median"))


def cadence_mode(cases: DataFrame, keys: list[str], week: str = "week_start_date", number: str = "weekofyear") -> DataFrame:
    """Most common start weekday and week-number offset; the smallest wins a tie."""
    from weekloom.functions.calendar import week_offset

    tagged = cases.select(
        *keys, F.weekday(week).cast("int").alias("start_weekday"), week_offset(number, week).alias("week_offset")
    )
    # One count of the pairs, at most 7 x 53 a key, serves both numbers; the windows see those.
    names = ("start_weekday", "week_offset")
    pairs = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    totals = [F.sum("_n").over(Window.partitionBy(*keys, c)).alias(f"_n_{c}") for c in names]
    picks = [F.max(F.struct(F.col(f"_n_{c}"), (-F.col(c)).alias("_v"))).alias(f"_b_{c}") for c in names]
    best = pairs.select(*keys, *names, *totals).groupBy(*keys).agg(*picks)
    return best.select(*keys, *[(-F.col(f"_b_{c}._v")).alias(c) for c in names])
