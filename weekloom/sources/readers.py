"""Readers for landed files. Schemas are given, never inferred; bad rows raise or turn NULL by rule."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from weekloom import schemas as S
from weekloom.functions.calendar import iso_week, iso_year
from weekloom.functions.cleaning import fold_name
from weekloom.operators import quality as Q
from weekloom.operators.joins import conform, features_with_labels


def _strict(column: str, kind: str) -> Column:
    """Cast that raises on text that is not a value of ``kind``; blank is NULL."""
    text = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    value = text.try_cast(kind)
    wrong = F.concat(F.lit(f"{column} is not a {kind}: "), text)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(wrong).cast(kind))


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table in the given schema; an empty one where nothing was written yet."""
    try:
        return conform(spark.read.parquet(path), schema)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def read_weekly_cases(spark: SparkSession, path: str, geographies: list[str] | None = None) -> DataFrame:
    """Weekly case CSV with a header: strict numbers, ISO year and week added, error when empty.

    Columns missing in older files read as NULL.
    """
    raw = spark.read.option("header", True).csv(path)
    Q.require_columns(raw, ["geography", "week_start_date", "total_cases"])
    if "hospitalized_cases" not in raw.columns:
        raise Q.QualityError("the table predates the hospitalization column; ingest again")
    if geographies is not None:
        raw = raw.filter(F.col("geography").isin(geographies))
    counts = ("total_cases", "pcr_cases", "igm_cases", "hospitalized_cases")
    cast = {
        **{c: F.rint(_strict(c, "double")).cast("bigint") for c in counts if c in raw.columns},
        "week_start_date": _strict("week_start_date", "date"),
        "complete_week": F.lower("complete_week").cast("boolean") if "complete_week" in raw.columns else F.lit(None),
    }
    typed = conform(raw.select(*[cast.get(c, F.col(c)).alias(c) for c in raw.columns]), S.CASE_TABLE)
    Q.require_rows(typed, "the case table has no rows for the geographies asked for")
    return typed.select("*", iso_year("week_start_date").alias("year"), iso_week("week_start_date").alias("weekofyear"))


def read_daily_case_json(spark: SparkSession, path: str, geography: Column) -> DataFrame:
    """Daily record lists (gzip or plain): one row per series and diagnostic day.

    Duplicate days and negative counts fail at run time inside the same aggregation.
    """
    raw = spark.read.schema(S.DAILY_CASE_RECORD).option("multiLine", True).json(path)
    rows = raw.select(
        geography.alias("geography"),
        F.to_date(F.to_timestamp("diagnosticDate")).alias("diagnostic_date"),
        F.col("totalCasesPcrCount").alias("pcr_cases"),
        F.col("totalCasesIgMCount").alias("igm_cases"),
        F.col("totalHospitalizedCount").alias("hospitalized_cases"),
    )
    return Q.single_side(refuse_negative(rows, ["pcr_cases", "igm_cases", "hospitalized_cases"]), ["geography", "diagnostic_date"], "daily record")


def refuse_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise when a negative count is read; NULL passes."""
    return df.select(
        *[
            F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is negative")).cast(t)).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c, t in df.dtypes
        ]
    )


def _column_block(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ["time", *fields]])


def _unzip(block: Column, fields: list[str]) -> Column:
    """Rows of a columnar block; arrays of unequal length raise."""
    size = F.size(block["time"])
    whole = block["time"].isNotNull()
    for name in fields:
        whole = whole & (F.size(block[name]) == size)
    zipped = F.arrays_zip(*[block[n].alias(n) for n in ["time", *fields]])
    names = ", ".join(["time", *fields])
    return F.when(whole, zipped).otherwise(
        F.raise_error(F.lit(f"columnar weather lacks a field or has unequal lengths: {names}")).cast(
            T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ["time", *fields]]))
        )
    )


def read_columnar_daily_json(spark: SparkSession, path: str, source: Column, extra: list[str] | None = None) -> DataFrame:
    """``{"daily": {"time": [...], field: [...]}}`` files to tidy daily rows; bad numbers turn NULL.

    ``extra`` names further top-level text fields to keep, such as the point's code.
    """
    extra = extra or []
    schema = T.StructType(
        [T.StructField("daily", _column_block(S.DAILY_WEATHER))] + [T.StructField(c, T.StringType()) for c in extra]
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(*extra, source.alias("weather_source"), F.explode(_unzip(F.col("daily"), S.DAILY_WEATHER)).alias("r"))
    return rows.select(
        *extra,
        F.to_date(F.to_timestamp("r.time")).alias("date"),
        *[F.col(f"r.{c}").try_cast("double").alias(c) for c in S.DAILY_WEATHER],
        "weather_source",
    )


def read_columnar_hourly_json(spark: SparkSession, path: str, points: list[str], source: str) -> DataFrame:
    """Forecast runs, each file a list with one hourly payload per point in a fixed order."""
    payload = T.ArrayType(T.StructType([T.StructField("hourly", _column_block(S.HOURLY_WEATHER))]))
    raw = spark.read.option("wholetext", True).text(path)
    runs = raw.select(F.input_file_name().alias("run_file"), F.from_json("value", payload).alias("payloads"))
    n = len(points)
    checked = F.when(F.size("payloads") == n, F.col("payloads")).otherwise(
        F.raise_error(F.lit(f"a forecast run must hold {n} payloads")).cast(payload)
    )
    each = runs.select("run_file", F.posexplode(checked).alias("_pos", "_payload"))
    codes = F.array(*[F.lit(p) for p in points])
    rows = each.select(
        "run_file",
        F.element_at(codes, F.col("_pos") + 1).alias("weather_point"),
        F.explode(_unzip(F.col("_payload.hourly"), S.HOURLY_WEATHER)).alias("r"),
    )
    return rows.select(
        "run_file",
        "weather_point",
        F.to_timestamp("r.time").alias("time"),
        *[F.col(f"r.{c}").try_cast("double").alias(c) for c in S.HOURLY_WEATHER],
        F.concat(F.lit(f"{source}:"), F.col("weather_point")).alias("weather_source"),
    )


def read_features_labels(
    spark: SparkSession, features: str, labels: str, keys: list[str], weather: list[str], target: str = "total_cases"
) -> DataFrame:
    """Feature and label CSVs joined one-to-one on their keys."""
    f = spark.read.option("header", True).csv(features)
    y = spark.read.option("header", True).csv(labels)
    Q.require_columns(f, [*keys, "week_start_date", *weather])
    Q.require_columns(y, [*keys, target])
    typed = f.select(
        *_typed_keys(keys),
        _strict("week_start_date", "date").alias("week_start_date"),
        *[_strict(c, "double").alias(c) for c in weather],
    )
    wanted = y.select(*_typed_keys(keys), _strict(target, "double").alias(target))
    return features_with_labels(typed, wanted, keys, target)


def _typed_keys(keys: list[str]) -> list[Column]:
    return [_strict(k, "int").alias(k) if k in ("year", "weekofyear") else F.col(k) for k in keys]


def read_recent_cases(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """User-supplied recent reports: folded codes, known series only, no negatives, no repeats."""
    raw = spark.read.option("header", True).csv(path)
    Q.require_columns(raw, ["city", "week_start_date", "total_cases"])
    code = F.lower(F.trim("city"))
    rows = raw.select(
        F.when(code.isin(known), code)
        .otherwise(F.raise_error(F.concat(F.lit("unknown series code: "), code)))
        .alias("city"),
        _strict("week_start_date", "date").alias("week_start_date"),
        _strict("total_cases", "double").alias("total_cases"),
    )
    return Q.single_side(refuse_negative(rows, ["total_cases"]), ["city", "week_start_date"], "recent case")


def read_case_level_csv(spark: SparkSession, path: str) -> DataFrame:
    """Case-level CSV of unknown encoding with folded lower-case column names.

    A line with bytes that are not UTF-8 is Latin-1, so files of both kinds can lie together. The
    text is read once; every file starts with the same header line.
    """
    raw = spark.read.text(path)
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.regexp_replace(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(latin), "^\ufeff", "")
    lines = raw.select(text.alias("line")).filter(F.length("line") > 0)
    header = lines.first()
    if header is None:
        raise Q.QualityError("the case-level file is empty")
    names = [fold_name(c).lower().replace(" ", "_") for c in next(csv.reader([header["line"]]))]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.filter(F.col("line") != header["line"]).select(F.from_csv("line", schema).alias("r")).select("r.*")
    return Q.require_columns(rows, ["ano", "semana", "departamento", "provincia", "distrito", "tipo_dx"])
