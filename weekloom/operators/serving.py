"""Chart rows, compact reports and the nested serving snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.rules import freshness_level
from weekloom.operators.ledger import latest_complete_issue

REPORT_NAMES = {
    "week_start_date": "date",
    "year": "year",
    "forecast_variant": "variant",
    "actual_cases": "actual",
    "outbreak_threshold": "threshold",
    "actual_outbreak": "outbreak",
    "predicted_cases_p50": "p50",
    "predicted_cases_p80": "p80",
    "predicted_cases_p90": "p90",
}


def compact_report(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Short names, whole years and labels, values to three places."""
    out = [F.col(c) for c in keep or []]
    for name, short in REPORT_NAMES.items():
        c = F.col(name)
        if short in ("year", "outbreak"):
            c = c.cast("int")
        elif short not in ("date", "variant"):
            c = F.round(c.cast("double"), 3)
        out.append(c.alias(short))
    return df.select(*out)


def forecast_view() -> Column:
    """Public part of a ledger row."""
    return F.struct(
        F.col("week_start_date").alias("weekStart"),
        F.col("lead_weeks").cast("bigint").alias("leadWeeks"),
        F.col("time_scope").alias("timeScope"),
        F.struct(
            F.col("predicted_cases_p50").alias("p50"),
            F.col("predicted_cases_p80").alias("p80"),
            F.col("predicted_cases_p90").alias("p90"),
            F.col("historical_outbreak_threshold_cases").alias("seasonalThreshold"),
            F.col("case_risk_level").alias("riskLevel"),
            F.col("case_forecast_reliability").alias("reliability"),
        ).alias("cases"),
        F.struct(
            F.col("outbreak_probability").alias("probability"),
            F.col("alert_gate").alias("alertGate"),
            F.col("outbreak_alert").alias("alert"),
            F.col("outbreak_definition").alias("definition"),
        ).alias("outbreak"),
    )


def tail_weeks(cases: DataFrame, keys: list[str], weeks: int | None) -> DataFrame:
    """The last N weeks of each series; all of them without N."""
    if weeks is None:
        return cases
    w = Window.partitionBy(*keys).orderBy(F.col("week_start_date").desc())
    return cases.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= weeks).drop("_rn")


def reported_and_estimated(cases: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Reported weeks and forecast weeks in one chart shape."""
    none = F.lit(None)
    reported = cases.select(
        *keys,
        F.lit("reported").alias("row_type"),
        F.col("week_start_date"),
        F.col("total_cases").cast("bigint").alias("cases"),
        F.col("hospitalized_cases").cast("bigint").alias("hospitalized"),
        *[none.cast("double").alias(c) for c in ("most_likely", "higher", "highest")],
    )
    estimated = ledger.select(
        *keys,
        F.lit("estimate").alias("row_type"),
        F.col("week_start_date"),
        none.cast("bigint").alias("cases"),
        none.cast("bigint").alias("hospitalized"),
        F.col("predicted_cases_p50").alias("most_likely"),
        F.col("predicted_cases_p80").alias("higher"),
        F.col("predicted_cases_p90").alias("highest"),
    )
    return reported.unionByName(estimated)


def serving_snapshot(
    ledger: DataFrame,
    cases: DataFrame,
    series: list[str],
    models: DataFrame | None = None,
    monitoring: DataFrame | None = None,
    history_weeks: int | None = None,
) -> DataFrame:
    """One nested row per series: signal, history, freshness, model and held-out block.

    ``models`` (series, model_version, model_variant, case_test_weeks, p80_coverage,
    p90_coverage) is matched on version and variant so that no other model's coverage is
    shown. ``monitoring`` (series, evaluated_rows) is the prospective score.
    The history of a series is one array of weeks: at most the length of the calendar.
    """
    issue = latest_complete_issue(ledger, series)
    zero, one = F.col("lead_weeks") == 0, F.col("lead_weeks") == 1
    current = issue.groupBy(*series).agg(
        F.max(F.when(zero, forecast_view())).alias("currentWeek"),
        F.max(F.when(one, forecast_view())).alias("nextWeek"),
        *[
            F.max(F.when(zero, F.col(c))).alias(c)
            for c in (
                "generated_at_utc",
                "as_of_date",
                "latest_case_week",
                "case_data_age_weeks",
                "case_source_publication_date",
                "weather_days_available",
                "forecast_input_days",
                "model_version",
                "model_variant",
                "training_data_cutoff",
                "input_vintage_basis",
                "held_out_case_mae",
                "held_out_normal_week_mae",
                "held_out_outbreak_week_mae",
                "held_out_precision",
                "held_out_recall",
                "held_out_f1",
                "held_out_pr_auc",
                "held_out_brier",
            )
        ],
    )
    shown = tail_weeks(cases.filter("complete_week"), series, history_weeks)
    history = shown.groupBy(*series).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("week_start_date").alias("weekStart"),
                    F.col("total_cases").cast("bigint").alias("totalCases"),
                    F.col("pcr_cases").cast("bigint").alias("pcrCases"),
                    F.col("igm_cases").cast("bigint").alias("igmCases"),
                    F.col("hospitalized_cases").cast("bigint").alias("hospitalizedCases"),
                )
            )
        ).alias("history")
    )
    joined = current.join(history, series, "left")
    if models is not None:
        m = models.select(*series, "model_version", "model_variant", "case_test_weeks", "p80_coverage", "p90_coverage")
        joined = joined.join(m, [*series, "model_version", "model_variant"], "left")
    else:
        joined = joined.select(
            "*",
            F.lit(None).cast("bigint").alias("case_test_weeks"),
            F.lit(None).cast("double").alias("p80_coverage"),
            F.lit(None).cast("double").alias("p90_coverage"),
        )
    if monitoring is not None:
        joined = joined.join(monitoring.select(*series, "evaluated_rows"), series, "left")
    else:
        joined = joined.withColumn("evaluated_rows", F.lit(0).cast("bigint"))
    age = F.col("case_data_age_weeks")
    held = {
        "caseMae": "held_out_case_mae",
        "normalWeekMae": "held_out_normal_week_mae",
        "outbreakWeekMae": "held_out_outbreak_week_mae",
        "precision": "held_out_precision",
        "recall": "held_out_recall",
        "f1": "held_out_f1",
        "prAuc": "held_out_pr_auc",
        "brier": "held_out_brier",
        "caseTestWeeks": "case_test_weeks",
        "lowerHighEstimateCoverage": "p80_coverage",
        "upperHighEstimateCoverage": "p90_coverage",
    }
    return joined.select(
        *series,
        F.col("generated_at_utc").alias("issuedAt"),
        F.col("as_of_date").alias("asOfDate"),
        F.struct("currentWeek", "nextWeek").alias("signal"),
        "history",
        F.struct(
            freshness_level(age).alias("level"),
            F.col("latest_case_week").alias("latestOfficialCaseWeek"),
            age.alias("officialCaseAgeWeeks"),
            F.col("case_source_publication_date").alias("caseSourcePublicationDate"),
            F.col("weather_days_available").alias("weatherDaysAvailable"),
            F.col("forecast_input_days").alias("forecastInputDays"),
        ).alias("freshness"),
        F.struct(
            F.col("model_version").alias("version"),
            F.col("model_variant").alias("variant"),
            F.col("training_data_cutoff").alias("trainingDataCutoff"),
            F.col("input_vintage_basis").alias("inputVintageBasis"),
            F.struct(*[F.col(c).alias(n) for n, c in held.items()]).alias("heldOut"),
            F.struct(F.coalesce("evaluated_rows", F.lit(0)).alias("evaluatedRows")).alias("prospective"),
        ).alias("model"),
    )


def to_json_lines(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.to_json(F.struct("*")).alias("value"))
