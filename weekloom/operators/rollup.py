"""Daily records, case rows and weather rolled up into complete weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import stored_small
from weekloom import schemas as S
from weekloom.functions.calendar import iso_week_start, week_floor
from weekloom.functions.cleaning import fold_text
from weekloom.operators.spine import spine

MEASURES = ["pcr_cases", "igm_cases", "hospitalized_cases"]


def weekly_case_rollup(daily: DataFrame, keys: list[str], day: str = "diagnostic_date") -> DataFrame:
    """Daily counts to Monday weeks. A week stands only with 7 reported days of each measure.

    Days without a row add nothing to a count of reported days, so the completeness rule
    needs no calendar; use ``spine`` when the gaps themselves are wanted.
    """
    weekly = daily.groupBy(*keys, week_floor(day).alias("week_start_date")).agg(
        *[F.sum(c).alias(c) for c in MEASURES],
        *[F.count(c).alias(f"_days_{c}") for c in MEASURES],
    )
    full = (
        (F.col("_days_pcr_cases") == 7)
        & (F.col("_days_igm_cases") == 7)
        & (F.col("_days_hospitalized_cases") == 7)
    )
    return weekly.filter(full).select(
        *keys,
        "week_start_date",
        (F.col("pcr_cases") + F.col("igm_cases")).cast("bigint").alias("total_cases"),
        *[F.col(c).cast("bigint").alias(c) for c in MEASURES],
        F.lit(True).alias("complete_week"),
    )


def category_filter(
    rows: DataFrame,
    places: dict[str, list[str]],
    class_column: str,
    classes: tuple[str, ...] = ("C", "P"),
    year: str = "ano",
    week: str = "semana",
) -> DataFrame:
    """Keep folded place names and diagnosis classes with a readable year and week."""
    keep = fold_text(class_column).isin(*classes)
    for column, names in places.items():
        keep = keep & fold_text(column).isin(*names)
    y, w = F.col(year).try_cast("double"), F.col(week).try_cast("double")
    return rows.filter(keep & y.isNotNull() & w.isNotNull())


def _whole(column: str) -> Column:
    return F.col(column).try_cast("double").try_cast("int")


def count_case_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Case rows per distinct combination of raw values, as ``case_rows``.

    Places and classes repeat endlessly, so text rules are applied to the combinations and
    not to the rows.
    """
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("case_rows"))


def fold_names(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the folded text of columns that repeat few names: each distinct name is folded once and joined back."""
    for column, folded in columns.items():
        names = stored_small(rows.select(column).distinct().withColumn(folded, fold_text(column)), "names")
        rows = rows.join(names, column, "left")
    return rows


def case_rows_weekly(
    rows: DataFrame, places: dict[str, list[str]], class_column: str, geography: str, key: str = "geography",
    classes: tuple[str, ...] = ("C", "P"), year: str = "ano", week: str = "semana",
) -> DataFrame:
    """Raw case rows to weekly counts by folded ``geography``: rows are counted once, names folded once, counts added.

    What ``category_filter`` keeps row by row is decided here on the names.
    """
    texts = list(dict.fromkeys([*places, class_column, geography]))
    counted = stored_small(count_case_rows(rows, [*texts, year, week]), "case-rows")
    folded = fold_names(counted, {c: f"_f_{c}" for c in texts})
    keep = F.col(f"_f_{class_column}").isin(*classes)
    for column, names in places.items():
        keep = keep & F.col(f"_f_{column}").isin(*names)
    kept = folded.where(keep & F.col(year).try_cast("double").isNotNull() & F.col(week).try_cast("double").isNotNull())
    return case_level_weekly(kept.withColumn(key, F.col(f"_f_{geography}")), [key], year, week, "case_rows")


def case_level_weekly(
    cases: DataFrame, keys: list[str], year: str = "ano", week: str = "semana", weight: str | None = None
) -> DataFrame:
    """Case rows to weekly counts; a quiet week inside the span is a real zero.

    ``weight`` names a count column of rows that were counted before.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        cases.groupBy(*keys, _whole(year).alias("_y"), _whole(week).alias("_w"))
        .agg(amount.alias("total_cases"))
        .select(*keys, iso_week_start("_y", "_w", strict=True).alias("week_start_date"), "total_cases")
    )
    full = spine(counted, keys, "week_start_date", "week", zero=["total_cases"])
    return full.select(
        *keys,
        "week_start_date",
        F.col("total_cases").cast("bigint").alias("total_cases"),
        F.lit(None).cast("bigint").alias("pcr_cases"),
        F.lit(None).cast("bigint").alias("igm_cases"),
        F.lit(None).cast("bigint").alias("hospitalized_cases"),
        F.lit(True).alias("complete_week"),
    )


def _call(kind: str, column: Column) -> Column:
    return {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[kind](column)


def hourly_aggregates(hours: str) -> list[Column]:
    """Daily fields from hourly ones, and ``hours``: the readings of the field that has the fewest."""
    return [
        F.avg("temperature_2m").alias("temperature_2m_mean"),
        F.max("temperature_2m").alias("temperature_2m_max"),
        F.min("temperature_2m").alias("temperature_2m_min"),
        F.sum("precipitation").alias("precipitation_sum"),
        F.sum("rain").alias("rain_sum"),
        F.count_if(F.col("precipitation") >= S.WET_DAY_MM).cast("double").alias("precipitation_hours"),
        F.avg("relative_humidity_2m").alias("relative_humidity_2m_mean"),
        F.avg("dew_point_2m").alias("dew_point_2m_mean"),
        F.avg("soil_moisture_0_to_7cm").alias("soil_moisture_0_to_7cm_mean"),
        F.sum("et0_fao_evapotranspiration").alias("et0_fao_evapotranspiration"),
        F.least(*[F.count(c) for c in S.HOURLY_WEATHER]).alias(hours),
    ]


def hourly_to_daily(hourly: DataFrame, keys: list[str], time: str = "time", target: str | None = None) -> DataFrame:
    """Hourly fields to daily ones, kept only for weeks with 24 readings of every field on all 7 days.

    ``target`` names a week-start column; without it the Monday of each hour is the week.
    """
    clock = F.col(time).cast("timestamp")
    week = F.col(target).cast("date") if target else week_floor(clock)
    tagged = hourly.withColumn("_week", week).withColumn("date", clock.cast("date"))
    if target:
        tagged = tagged.filter(F.col("date").between(F.col("_week"), F.date_add("_week", 6)))
    f = F.col
    daily = tagged.groupBy(*keys, "_week", "date").agg(*hourly_aggregates("_hours"))
    # Seven rows per window group at most.
    same_week = Window.partitionBy(*keys, "_week")
    checked = daily.select(
        "*",
        F.count(F.lit(1)).over(same_week).alias("_days"),
        F.min("_hours").over(same_week).alias("_least"),
    )
    return checked.filter("_days = 7 AND _least >= 24").select(
        *keys, f("_week").alias("week_start_date"), "date", *S.DAILY_WEATHER
    )


def all_present(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def spatial_daily(points: DataFrame, keys: list[str], expected_points: int, day: str = "date") -> DataFrame:
    """Point rows to one area row per day; all fields NULL unless every point is complete."""
    complete = all_present(S.DAILY_WEATHER)
    area = points.groupBy(*keys, day).agg(
        *[_call(kind, F.col(c)).alias(c) for c, kind in S.AREA_AGGREGATE.items()],
        # The point set is small and fixed, so the set stays small too.
        F.size(F.collect_set(F.when(complete, F.col("weather_point")))).cast("bigint").alias("point_count"),
        F.collect_set("weather_source").alias("_sources"),
    )
    # Every source the area drew on, on all of its days: a few names an area, from the stored days.
    area = stored_small(area, "area-days")
    drawn = stored_small(
        area.select(*keys, F.explode("_sources").alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_set("_s")).alias("_drawn"))
    )
    area = area.join(drawn, keys, "left")
    sources = F.concat_ws("+", "_drawn")
    whole = F.col("point_count") == expected_points
    return area.select(
        *keys,
        day,
        *[F.when(whole, F.col(c)).alias(c) for c in S.DAILY_WEATHER],
        "point_count",
        F.coalesce(F.nullif(sources, F.lit("")), F.lit("missing")).alias("weather_source"),
    )


def daily_to_weekly(
    daily: DataFrame,
    keys: list[str],
    weeks: DataFrame | None = None,
    day: str = "date",
    as_of: Column | None = None,
    start_weekday: int | Column = 0,
) -> DataFrame:
    """Daily weather to weekly: all values NULL together unless all 7 days are complete.

    ``weeks`` (keys, week_start_date) lists the weeks wanted; weeks without weather then
    appear with 0 days and source ``missing``. ``start_weekday`` may be a column of ``daily``. The dry spell is the longest run of days
    with less than 0.1 mm, found in the week's at most 7 (day, rain) pairs.
    """
    dated = daily.withColumn("_d", F.col(day).cast("date"))
    rain = F.col("rain_sum")
    ahead = F.lit(0) if as_of is None else F.count_if(F.col("_d") > as_of)
    weekly = dated.groupBy(*keys, week_floor("_d", start_weekday).alias("week_start_date")).agg(
        *[_call(kind, F.col(c)).alias(c) for c, kind in S.WEEKLY_AGGREGATE.items()],
        F.count_if(rain >= S.WET_DAY_MM).cast("double").alias("wet_day_count"),
        F.count_if(rain >= S.HEAVY_RAIN_MM).cast("double").alias("heavy_rain_day_count"),
        F.max(rain).alias("max_daily_rainfall"),
        F.array_sort(F.collect_list(F.struct("_d", (rain < S.WET_DAY_MM).alias("dry")))).alias("_run"),
        F.count_if(all_present(S.DAILY_WEATHER)).alias("weather_days_available"),
        ahead.cast("bigint").alias("forecast_input_days"),
        F.concat_ws("+", F.array_sort(F.collect_set("weather_source"))).alias("weather_sources"),
    )
    spell = longest_run_of("_run", "dry")
    if weeks is not None:
        weekly = weeks.select(*keys, "week_start_date").distinct().join(weekly, [*keys, "week_start_date"], "left")
    full = F.coalesce(F.col("weather_days_available"), F.lit(0)) >= 7
    plain = [c for c in S.WEEKLY_WEATHER if c != "longest_dry_spell_days"]
    return weekly.select(
        *keys,
        "week_start_date",
        *[F.when(full, F.col(c)).alias(c) for c in plain],
        F.when(full, spell.cast("double")).alias("longest_dry_spell_days"),
        F.coalesce("weather_days_available", F.lit(0)).cast("bigint").alias("weather_days_available"),
        F.coalesce("forecast_input_days", F.lit(0)).cast("bigint").alias("forecast_input_days"),
        F.coalesce(F.nullif(F.col("weather_sources"), F.lit("")), F.lit("missing")).alias("weather_sources"),
    )


def longest_run_of(items: str, flag: str) -> Column:
    """Longest run of true ``flag`` in a short array of structs that is already in order."""
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top"))

    def step(acc: Column, item: Column) -> Column:
        cur = F.when(item[flag], acc["cur"] + 1).otherwise(F.lit(0))
        return F.struct(cur.alias("cur"), F.greatest(acc["top"], cur).alias("top"))

    return F.aggregate(items, start, step, lambda acc: acc["top"])


def longest_run(df: DataFrame, keys: list[str], order: str, condition: Column, name: str = "longest_run") -> DataFrame:
    """Longest run of consecutive rows meeting ``condition`` per key, as gaps and islands.

    ``keys`` must bound the rows of a group, for example series and week.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    w2 = Window.partitionBy(*keys, "_hit").orderBy(order)
    hit = F.coalesce(condition, F.lit(False))
    islands = (
        df.select(*keys, order, hit.alias("_hit"))
        .withColumn("_all", F.row_number().over(w))
        .withColumn("_island", F.col("_all") - F.row_number().over(w2))
        .groupBy(*keys, "_hit", "_island")
        .agg(F.count(F.lit(1)).alias("_len"))
    )
    return islands.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_hit"), F.col("_len"))), F.lit(0)).alias(name))
