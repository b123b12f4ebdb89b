"""Which held-out weeks have forecast weather that existed before their decision, and how much of the past that covers.

Issued runs are a two-time table: when a run was issued, which week it speaks of. The run that counts for a week is
the newest one issued by the decision time, so later runs of the same week never leak in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = "week_start_date"
DISABLED, EMPTY, COMPLETE = "disabled", "no_archived_weeks", "complete"
BASIS = "archived_single_runs_issued_before_target_week"


def decision_time(week: str = WEEK, days_before: int = 1, run_hour: int = 0) -> Column:
    """UTC time by which a run must have been issued to count for the week."""
    return F.timestamp_add("HOUR", F.lit(run_hour), F.date_sub(F.col(week), days_before).cast("timestamp"))


def newest_runs(issued: DataFrame, keys: list[str], issued_at: str = "issued_at_utc", days_before: int = 1, run_hour: int = 0) -> DataFrame:
    """One row per key and week: the newest run issued by the decision time, with its issue time."""
    known = issued.where(F.col(issued_at) <= decision_time(WEEK, days_before, run_hour))
    rest = [c for c in issued.columns if c not in [*keys, WEEK]]
    newest = known.groupBy(*keys, WEEK).agg(F.max_by(F.struct(*rest), F.col(issued_at)).alias("_r"))
    return newest.select(*keys, WEEK, "_r.*")


def islands(weeks: DataFrame, keys: list[str], week: str = WEEK) -> DataFrame:
    """(keys, island_start, island_end, weeks): runs of weeks that follow each other; a series' weeks are bounded by the calendar."""
    w = Window.partitionBy(*keys).orderBy(week)
    place = F.datediff(week, F.lit("1970-01-01").cast("date")) - 7 * F.row_number().over(w)
    marked = weeks.select(*keys, week).distinct().select(*keys, week, place.alias("_island"))
    return marked.groupBy(*keys, "_island").agg(
        F.min(week).alias("island_start"), F.max(week).alias("island_end"), F.count(F.lit(1)).alias("weeks")
    ).drop("_island")


def audit_coverage(
    labelled: DataFrame, runs: DataFrame, keys: list[str], available_from: Column, days_before: int = 1, run_hour: int = 0, enabled: bool = True
) -> DataFrame:
    """One row per series: status, eligible, covered and uncovered weeks, span, islands, issue rule.

    ``labelled`` holds the weeks that have a label, ``runs`` the usable run of each week (``newest_runs``). Eligible are the
    labelled weeks since ``available_from``; a series without a covered one has status ``no_archived_weeks``.
    """
    weeks = labelled.select(*keys, WEEK).distinct().where(F.col(WEEK) >= available_from.cast("date"))
    covered = weeks.join(runs.select(*keys, WEEK).distinct(), [*keys, WEEK])
    found = islands(covered, keys).groupBy(*keys).agg(
        F.sum("weeks").alias("covered_weeks"), F.min("island_start").alias("coverage_start"), F.max("island_end").alias("coverage_end"),
        F.count(F.lit(1)).alias("coverage_islands"), F.max("weeks").alias("longest_island_weeks"),
    )
    everyone = labelled.groupBy(*keys).agg(F.count_if(F.col(WEEK) >= available_from.cast("date")).alias("eligible_archived_weeks"))
    both = everyone.join(found, keys, "left")
    none = F.lit(0).cast("bigint")
    some = F.coalesce("covered_weeks", none)
    status = F.when(F.lit(not enabled), DISABLED).when(some == 0, EMPTY).otherwise(COMPLETE)
    return both.select(
        *keys, status.alias("status"), F.when(F.lit(enabled), F.lit(BASIS)).otherwise("not_requested").alias("weather_basis"),
        F.lit(days_before).alias("issue_days_before_target_week"), F.lit(run_hour).alias("issue_run_hour_utc"), "eligible_archived_weeks",
        some.alias("covered_weeks"), (F.col("eligible_archived_weeks") - some).alias("uncovered_archived_weeks"),
        "coverage_start", "coverage_end", F.coalesce("coverage_islands", none).alias("coverage_islands"),
        F.coalesce("longest_island_weeks", none).alias("longest_island_weeks"),
    )
