"""Lag, rolling, case-history, delayed-report and issue-time features.

A window group is one series of weekly rows, so its size is the length of the calendar.
All features of a table use one window order, hence one shuffle and one sort.
``calendar=True`` looks up exact weeks by range frames on the week index; the default is
positional, as training does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.functions.calendar import harmonics, iso_week, week_index, weekday_phase, weeks_between
from weekloom.functions.cleaning import finite
from weekloom.functions.rules import hospital_rate

WEEK = "week_start_date"


class Past:
    """Frames over one series, by row position or by exact calendar week."""

    def __init__(self, keys: list[str], order: str = WEEK, calendar: bool = False):
        self.calendar = calendar
        if calendar:
            self.w = Window.partitionBy(*keys, weekday_phase(order)).orderBy(week_index(order))
        else:
            self.w = Window.partitionBy(*keys).orderBy(order)

    def frame(self, start: int, end: int):
        return self.w.rangeBetween(start, end) if self.calendar else self.w.rowsBetween(start, end)

    def lag(self, column: Column, k: int) -> Column:
        if k == 0:
            return column
        return F.first(column).over(self.frame(-k, -k)) if self.calendar else F.lag(column, k).over(self.w)

    def agg(self, kind: str, column: Column, newest: int, count: int, minimum: int | None = None) -> Column:
        """Aggregate of ``count`` weeks ending ``newest`` weeks back; NULL below ``minimum`` values."""
        f = self.frame(-(newest + count - 1), -newest)
        value = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[kind](column).over(f)
        need = count if minimum is None else minimum
        return value if need <= 1 else F.when(F.count(column).over(f) >= need, value)


def weather_features(
    weekly: DataFrame, keys: list[str], columns: list[str] | None = None, calendar: bool = False
) -> DataFrame:
    """Harmonics, lags 0/2/4/8 and full 4 and 8 week rolling values of each weather field."""
    columns = columns or S.FORECAST_WEATHER
    past = Past(keys, calendar=calendar)
    base = weekly if "weekofyear" in weekly.columns else weekly.withColumn("weekofyear", iso_week(WEEK))
    made = [c.alias(n) for n, c in harmonics("weekofyear").items()]
    for name in columns:
        c = F.col(name)
        made += [past.lag(c, k).alias(f"{name}_lag_{k}") for k in S.WEATHER_LAGS]
        made += [past.agg(S.rolling_kind(name), c, 0, n).alias(f"{name}_rolling_{n}") for n in S.ROLLING_WEEKS]
    return base.select("*", *made)


def case_lags(
    cases: DataFrame, keys: list[str], value: str = "total_cases", family: str = "operational", calendar: bool = False
) -> DataFrame:
    """Strictly past case features.

    ``operational``: lags 1, 2, 4 and means that need all 4 or 8 weeks.
    ``historical``: also lag 52, and means over whatever past exists.
    """
    past, c = Past(keys, calendar=calendar), F.col(value).cast("double")
    least = 1 if family == "historical" else None
    made = {f"cases_lag_{k}": past.lag(c, k) for k in (1, 2, 4)}
    if family == "historical":
        made["cases_lag_52"] = past.lag(c, 52)
    made["cases_mean_4"] = past.agg("avg", c, 1, 4, least)
    made["cases_mean_8"] = past.agg("avg", c, 1, 8, least)
    made["cases_change_1"] = past.lag(c, 1) - past.lag(c, 2)
    return cases.select("*", *[v.alias(n) for n, v in made.items()])


def hospital_lags(cases: DataFrame, keys: list[str], calendar: bool = False) -> DataFrame:
    """Past hospitalization features with the training zero rule."""
    past = Past(keys, calendar=calendar)
    h, c = F.col("hospitalized_cases").cast("double"), F.col("total_cases").cast("double")
    rate = hospital_rate(past.agg("sum", h, 1, 4), past.agg("sum", c, 1, 4))
    return cases.select(
        "*",
        past.lag(h, 1).alias("hospitalized_lag_1"),
        past.lag(h, 2).alias("hospitalized_lag_2"),
        past.agg("avg", h, 1, 4).alias("hospitalized_mean_4"),
        rate.alias("hospitalization_rate_mean_4"),
    )


def health_features(cases: DataFrame, keys: list[str], calendar: bool = False) -> DataFrame:
    return hospital_lags(case_lags(cases, keys, calendar=calendar), keys, calendar=calendar)


def _anchor_values(past: Past) -> dict[str, Column]:
    """Features as known in the week of the newest report."""
    h, c = F.col("hospitalized_cases").cast("double"), F.col("total_cases").cast("double")
    return {
        "delayed_cases_latest": c,
        "delayed_cases_lag_1": past.lag(c, 1),
        "delayed_cases_lag_2": past.lag(c, 2),
        "delayed_cases_lag_4": past.lag(c, 4),
        "delayed_cases_mean_4": past.agg("avg", c, 0, 4),
        "delayed_cases_mean_8": past.agg("avg", c, 0, 8),
        "delayed_cases_change_1": c - past.lag(c, 1),
        "delayed_hospitalized_latest": h,
        "delayed_hospitalized_mean_4": past.agg("avg", h, 0, 4),
        "delayed_hospitalization_rate_mean_4": hospital_rate(past.agg("sum", h, 0, 4), past.agg("sum", c, 0, 4)),
    }


def delayed_features(
    cases: DataFrame, keys: list[str], delays: range | list[int] = range(4, 13), calendar: bool = False
) -> DataFrame:
    """One copy of each week per report delay, with features anchored that many weeks back.

    Anchor features are computed once and looked up at each delay in the same window order,
    so the fan-out adds no shuffle.
    """
    delays = [int(d) for d in delays]
    if min(delays) < 1:
        raise ValueError("a report delay is at least one week")
    past = Past(keys, calendar=calendar)
    anchored = cases.select("*", F.struct(*[v.alias(n) for n, v in _anchor_values(past).items()]).alias("_anchor"))
    copies = F.array(
        *[
            F.struct(past.lag(F.col("_anchor"), d).alias("a"), F.lit(float(d)).alias("report_age_weeks"))
            for d in delays
        ]
    )
    fanned = anchored.select(*cases.columns, copies.alias("_copies")).select(
        *cases.columns, F.explode("_copies").alias("_copy")
    )
    return fanned.select(
        *cases.columns,
        *[F.col(f"_copy.a.{n}").alias(n) for n in S.DELAYED_FEATURES if n != "report_age_weeks"],
        F.col("_copy.report_age_weeks").alias("report_age_weeks"),
    )


def delay_cross(targets: DataFrame, delays: range | list[int] = range(4, 13)) -> DataFrame:
    """Each target week once per delay, with the anchor week it may use."""
    days = F.array(*[F.lit(int(d)) for d in delays])
    return targets.select("*", F.explode(days).alias("delay_weeks")).withColumn(
        "anchor_week", F.date_sub(WEEK, F.col("delay_weeks") * 7)
    )


def _with_targets(history: DataFrame, targets: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    h = history.select(*keys, WEEK, *[F.col(v).cast("double").alias(v) for v in values], F.lit(False).alias("_target"))
    t = targets.select(
        *keys, WEEK, *[F.lit(None).cast("double").alias(v) for v in values], F.lit(True).alias("_target")
    )
    return h.unionByName(t)


def live_exact_features(
    history: DataFrame, targets: DataFrame, keys: list[str], hospital: bool = True
) -> DataFrame:
    """Exact case features of target weeks; a target without its 8 preceding weeks is absent.

    With ``hospital`` the last 4 weeks must also carry hospitalizations.
    """
    values = ["total_cases"] + (["hospitalized_cases"] if hospital else [])
    past = Past(keys, calendar=True)
    c = F.col("total_cases")
    made = {
        "cases_lag_1": past.agg("max", c, 1, 1),
        "cases_lag_2": past.agg("max", c, 2, 1),
        "cases_lag_4": past.agg("max", c, 4, 1),
        "cases_mean_4": past.agg("avg", c, 1, 4),
        "cases_mean_8": past.agg("avg", c, 1, 8),
    }
    made["cases_change_1"] = made["cases_lag_1"] - made["cases_lag_2"]
    ok = F.count(c).over(past.frame(-8, -1)) == 8
    if hospital:
        h = F.col("hospitalized_cases")
        made["hospitalized_lag_1"] = past.agg("max", h, 1, 1)
        made["hospitalized_lag_2"] = past.agg("max", h, 2, 1)
        made["hospitalized_mean_4"] = past.agg("avg", h, 1, 4)
        made["hospitalization_rate_mean_4"] = hospital_rate(
            F.sum(h).over(past.frame(-4, -1)), F.sum(c).over(past.frame(-4, -1)), "live"
        )
        ok = ok & (F.count(h).over(past.frame(-4, -1)) == 4)
    rows = _with_targets(history, targets, keys, values).select(
        *keys, WEEK, "_target", ok.alias("_ok"), *[v.alias(n) for n, v in made.items()]
    )
    return rows.filter("_target AND _ok").drop("_target", "_ok")


def asof_report(
    history: DataFrame, targets: DataFrame, keys: list[str], minimum_age: int = 4, maximum_age: int = 12
) -> DataFrame:
    """Newest report before each target; kept when its age is whole weeks within the bounds."""
    rows = _with_targets(history, targets, keys, [])
    w = Window.partitionBy(*keys).orderBy(F.datediff(WEEK, F.lit("1970-01-01").cast("date")))
    newest = F.max(F.when(~F.col("_target"), F.col(WEEK))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    found = rows.select(*keys, WEEK, "_target", newest.alias("case_report_anchor_week")).filter("_target")
    age = weeks_between(WEEK, "case_report_anchor_week")
    return (
        found.withColumn("report_age_weeks", age)
        .filter((age == F.floor(age)) & age.between(minimum_age, maximum_age))
        .drop("_target")
    )


def live_delayed_features(
    history: DataFrame, targets: DataFrame, keys: list[str], minimum_age: int = 4, maximum_age: int = 12
) -> DataFrame:
    """Features anchored at the newest report, only when 8 gap-free weeks end there."""
    past = Past(keys, calendar=True)
    h, c = F.col("hospitalized_cases").cast("double"), F.col("total_cases").cast("double")
    values = _anchor_values(past)
    eight = past.frame(-7, 0)
    ok = (F.count(c).over(eight) == 8) & (F.count(h).over(eight) == 8)
    values["delayed_hospitalization_rate_mean_4"] = hospital_rate(
        F.sum(h).over(past.frame(-3, 0)), F.sum(c).over(past.frame(-3, 0)), "live"
    )
    anchors = history.select(
        *keys, F.col(WEEK).alias("case_report_anchor_week"), ok.alias("_ok"), *[v.alias(n) for n, v in values.items()]
    ).filter("_ok")
    found = asof_report(history, targets, keys, minimum_age, maximum_age)
    return found.join(anchors, [*keys, "case_report_anchor_week"]).select(
        *keys, WEEK, "case_report_anchor_week", *S.DELAYED_FEATURES
    )


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def forward_fill(
    df: DataFrame, keys: list[str], columns: list[str], medians: DataFrame, order: str = WEEK
) -> DataFrame:
    """Fill forward in time and then with the training medians, without a look ahead.

    ``df`` holds training and later validation rows, ``medians`` one row per key. Validation
    weeks continue from the last training value; a training median is used only where no
    earlier value exists, so filling the last training row first changes nothing.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    renamed = medians.select(*keys, *[F.col(c).alias(f"_med_{c}") for c in columns])
    carried = df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_ff_{c}") for c in columns])
    joined = carried.join(renamed, keys, "left")
    rest = [c for c in df.columns if c not in columns]
    return joined.select(*rest, *[F.coalesce(f"_ff_{c}", f"_med_{c}").alias(c) for c in columns])


def selected_lag_features(
    df: DataFrame, keys: list[str], columns: list[str], chosen: DataFrame, maximum_lag: int = 12, order: str = WEEK
) -> DataFrame:
    """Each field at the lag chosen for its series, and the 4-week mean ending there.

    ``chosen`` holds (keys, column_name, best_lag). All candidate lags sit in one window;
    the chosen one is picked by its index, so series may differ. The mean skips NULLs.
    """
    past = Past(keys, order)
    picks = (
        chosen.groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("column_name", "best_lag"))).alias("_lags"))
    )
    wide = df.select(
        "*",
        *[
            F.array(*[past.lag(F.col(c).cast("double"), k) for k in range(maximum_lag + 4)]).alias(f"_past_{c}")
            for c in columns
        ],
    )
    joined = wide.join(picks, keys, "left")
    made = []
    for c in columns:
        k = F.col("_lags").getItem(c)
        p = F.col(f"_past_{c}")
        four = F.filter(F.slice(p, k + 1, 4), lambda x: x.isNotNull())
        made.append(F.element_at(p, k + 1).alias(f"{c}_chosen_lag"))
        made.append(
            F.when(
                F.size(four) > 0, F.aggregate(four, F.lit(0.0), lambda a, x: a + x) / F.size(four)
            ).alias(f"{c}_mean_4")
        )
    return joined.select(*df.columns, *made)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a NULL in ``columns``.

    One predicate over an array: a hundred separate null tests would each be tracked by the
    optimizer through every alias above them.
    """
    return df.filter(F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull()))


def nonfinite_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[finite(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def issue_time_overrides(
    observed: DataFrame, issued: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Features of target weeks rebuilt with forecast weather in the target week only.

    Earlier weeks stay as observed: a rolling value combines the observed past with the
    issued week, so no week is featured twice and nothing loops over targets.
    """
    columns = columns or S.FORECAST_WEATHER
    past = Past(keys)
    base = observed if "weekofyear" in observed.columns else observed.withColumn("weekofyear", iso_week(WEEK))
    parts = []
    for name in columns:
        c = F.col(name)
        parts += [past.lag(c, k).alias(f"_{name}_lag_{k}") for k in S.WEATHER_LAGS if k]
        for n in S.ROLLING_WEEKS:
            kind = "max" if S.rolling_kind(name) == "max" else "sum"
            parts.append(past.agg(kind, c, 1, n - 1).alias(f"_{name}_head_{n}"))
    heads = base.select(*keys, WEEK, "weekofyear", *parts)
    extra = [c for c in ("forecast_issue_run_utc",) if c in issued.columns]
    now = issued.select(*keys, WEEK, *[F.col(c).alias(f"_now_{c}") for c in columns], *extra)
    joined = heads.join(now, [*keys, WEEK])
    out = [c.alias(n) for n, c in harmonics("weekofyear").items()]
    for name in columns:
        fresh = F.col(f"_now_{name}")
        out.append(fresh.alias(f"{name}_lag_0"))
        out += [F.col(f"_{name}_lag_{k}").alias(f"{name}_lag_{k}") for k in S.WEATHER_LAGS if k]
        for n in S.ROLLING_WEEKS:
            head, kind = F.col(f"_{name}_head_{n}"), S.rolling_kind(name)
            known = head.isNotNull() & fresh.isNotNull()
            whole = {
                "max": F.greatest(head, fresh),
                "sum": head + fresh,
                "avg": (head + fresh) / F.lit(float(n)),
            }[kind]
            out.append(F.when(known, whole).alias(f"{name}_rolling_{n}"))
    return joined.select(*keys, WEEK, *extra, *out)


def apply_overrides(validation: DataFrame, overrides: DataFrame, on: list[str], features: list[str]) -> DataFrame:
    """Replace held-out features by issue-time values; weeks without a full set drop out.

    ``overrides`` must hold one row per key (checked by ``single_side`` in the join).
    """
    from weekloom.operators.quality import QualityError, single_side

    shared = [c for c in features if c in overrides.columns]
    if not shared:
        raise QualityError("overrides hold none of the model's features")
    new = single_side(overrides.select(*on, *shared), on, "override").dropna(subset=shared)
    fresh = new.select(*on, *[F.col(c).alias(f"_issued_{c}") for c in shared])
    joined = validation.join(fresh, on)
    return joined.select(*[F.col(f"_issued_{c}").alias(c) if c in shared else F.col(c) for c in validation.columns])
