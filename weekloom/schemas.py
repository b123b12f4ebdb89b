"""Fixed schemas, column lists and the per-column roll-up rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and rules of the data model.
CASE_TABLE = T.StructType(
    [
        T.StructField("geography", T.StringType()),
        T.StructField("week_start_date", T.DateType()),
        T.StructField("total_cases", T.LongType()),
        T.StructField("pcr_cases", T.LongType()),
        T.StructField("igm_cases", T.LongType()),
        T.StructField("hospitalized_cases", T.LongType()),
        T.StructField("complete_week", T.BooleanType()),
        T.StructField("source_file_id", T.StringType()),
        T.StructField("source_publication_date", T.StringType()),
        T.StructField("retrieved_at_utc", T.StringType()),
        T.StructField("source_page", T.StringType()),
    ]
)
CASE_COLUMNS = CASE_TABLE.names

DAILY_CASE_RECORD = T.StructType(
    [
        T.StructField("diagnosticDate", T.StringType()),
        T.StructField("totalCasesPcrCount", T.LongType()),
        T.StructField("totalCasesIgMCount", T.LongType()),
        T.StructField("totalHospitalizedCount", T.LongType()),
    ]
)

# Weekly aggregate of each daily weather field.
WEEKLY_AGGREGATE = {
    "temperature_2m_mean": "avg",
    "temperature_2m_max": "max",
    "temperature_2m_min": "min",
    "precipitation_sum": "sum",
    "rain_sum": "sum",
    "precipitation_hours": "sum",
    "relative_humidity_2m_mean": "avg",
    "dew_point_2m_mean": "avg",
    "soil_moisture_0_to_7cm_mean": "avg",
    "et0_fao_evapotranspiration": "sum",
}
DAILY_WEATHER = list(WEEKLY_AGGREGATE)
DERIVED_WEATHER = [
    "wet_day_count",
    "heavy_rain_day_count",
    "max_daily_rainfall",
    "longest_dry_spell_days",
]
WEEKLY_WEATHER = DAILY_WEATHER + DERIVED_WEATHER

# Area value of each daily field over its points: extremes stay extremes.
AREA_AGGREGATE = {c: "avg" for c in DAILY_WEATHER} | {
    "temperature_2m_max": "max",
    "temperature_2m_min": "min",
}

# Hourly forecast fields and the daily fields made from them.
HOURLY_WEATHER = [
    "temperature_2m",
    "precipitation",
    "rain",
    "relative_humidity_2m",
    "dew_point_2m",
    "soil_moisture_0_to_7cm",
    "et0_fao_evapotranspiration",
]

WET_DAY_MM = 0.1
HEAVY_RAIN_MM = 10.0
WEATHER_LAGS = (0, 2, 4, 8)
ROLLING_WEEKS = (4, 8)

# Fields used by the alert classifier, and the wider list of the forecaster.
ALERT_WEATHER = [c for c in DAILY_WEATHER if c != "rain_sum"] + [
    "wet_day_count",
    "max_daily_rainfall",
]
FORECAST_WEATHER = ALERT_WEATHER + ["heavy_rain_day_count", "longest_dry_spell_days"]

CASE_FEATURES = [
    "cases_lag_1",
    "cases_lag_2",
    "cases_lag_4",
    "cases_mean_4",
    "cases_mean_8",
    "cases_change_1",
]
HOSPITAL_FEATURES = [
    "hospitalized_lag_1",
    "hospitalized_lag_2",
    "hospitalized_mean_4",
    "hospitalization_rate_mean_4",
]
EXACT_FEATURES = CASE_FEATURES + HOSPITAL_FEATURES
DELAYED_FEATURES = [
    "delayed_cases_latest",
    "delayed_cases_lag_1",
    "delayed_cases_lag_2",
    "delayed_cases_lag_4",
    "delayed_cases_mean_4",
    "delayed_cases_mean_8",
    "delayed_cases_change_1",
    "delayed_hospitalized_latest",
    "delayed_hospitalized_mean_4",
    "delayed_hospitalization_rate_mean_4",
    "report_age_weeks",
]

VARIANTS = ("weather_only", "weather_plus_delayed_cases", "weather_plus_recent_cases")
RELIABILITY = {
    "weather_only": "limited_no_usable_case_history",
    "weather_plus_delayed_cases": "moderate_delayed_case_history",
    "weather_plus_recent_cases": "stronger_exact_recent_cases",
}
PERSISTED_BASIS = "prospective_persisted_issue_time_inputs"

LEDGER_KEY = ["geography", "as_of_date", "week_start_date", "lead_weeks", "model_version"]

_s, _d, _l, _b, _dt = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.BooleanType(),
    T.DateType(),
)
LEDGER = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("geography", _s),
            ("geography_name", _s),
            ("generated_at_utc", _s),
            ("as_of_date", _dt),
            ("week_start_date", _dt),
            ("lead_weeks", _l),
            ("time_scope", _s),
            ("model_version", _s),
            ("model_variant", _s),
            ("predicted_cases_p50", _d),
            ("predicted_cases_p80", _d),
            ("predicted_cases_p90", _d),
            ("case_forecast_reliability", _s),
            ("case_risk_level", _s),
            ("p50_above_threshold", _b),
            ("p80_above_threshold", _b),
            ("p90_above_threshold", _b),
            ("held_out_case_mae", _d),
            ("held_out_normal_week_mae", _d),
            ("held_out_outbreak_week_mae", _d),
            ("outbreak_probability", _d),
            ("alert_gate", _d),
            ("outbreak_alert", _b),
            ("historical_outbreak_threshold_cases", _d),
            ("outbreak_definition", _s),
            ("held_out_precision", _d),
            ("held_out_recall", _d),
            ("held_out_f1", _d),
            ("held_out_pr_auc", _d),
            ("held_out_brier", _d),
            ("training_data_cutoff", _dt),
            ("case_source_file_id", _s),
            ("case_source_publication_date", _s),
            ("latest_case_week", _dt),
            ("case_data_age_weeks", _d),
            ("case_report_anchor_week", _dt),
            ("case_report_age_weeks", _d),
            ("weather_days_available", _l),
            ("forecast_input_days", _l),
            ("weather_sources", _s),
            ("input_vintage_id", _s),
            ("input_vintage_basis", _s),
            ("actual_cases", _d),
            ("absolute_case_error", _d),
            ("actual_outbreak", _l),
            ("evaluated_at_utc", _s),
        ]
    ]
)
LEDGER_COLUMNS = LEDGER.names

MODEL_SCHEMA_VERSION = 5
CASE_FORECAST_SCHEMA_VERSION = 6


def weather_feature_names(columns: list[str]) -> list[str]:
    """Names of the calendar, lag and rolling features made from ``columns``."""
    names = [f"week_{fn}_{h}" for h in (1, 2) for fn in ("sin", "cos")]
    for c in columns:
        names += [f"{c}_lag_{k}" for k in WEATHER_LAGS]
        names += [f"{c}_rolling_{n}" for n in ROLLING_WEEKS]
    return names


def rolling_kind(column: str) -> str:
    """Aggregate used when a weekly weather field is rolled over several weeks."""
    if column == "longest_dry_spell_days":
        return "max"
    if WEEKLY_AGGREGATE.get(column) == "sum" or column.endswith("_day_count"):
        return "sum"
    return "avg"
