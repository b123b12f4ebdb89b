"""Structured Streaming operators over file or message sources.

Every stream runs to completion with ``availableNow`` in a backfill and continuously with a
processing-time trigger otherwise. Results go to Parquet, never to driver memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekloom.config import Policy
from weekloom.operators.ledger import attach_truth
from weekloom.operators.rollup import hourly_aggregates
from weekloom.schemas import DAILY_WEATHER
from weekloom.sources.sinks import read_ledger, upsert_ledger

STABILIZATION = f"{Policy.label_stabilization_weeks} weeks"

MONDAY = "4 days"  # the epoch was a Thursday


def weekly_rollup(daily: DataFrame, keys: list[str], measures: dict[str, Column], time: str = "ts", buffer: str = "4 weeks") -> DataFrame:
    """Weekly totals that appear once the stabilization buffer has passed.

    Later records are the batch revision diff's business. Sums combine before the shuffle.
    """
    return (
        daily.withWatermark(time, buffer)
        .groupBy(*keys, F.window(time, "7 days", startTime=MONDAY).alias("_w"))
        .agg(*[c.alias(n) for n, c in measures.items()])
        .select(*keys, F.col("_w.start").cast("date").alias("week_start_date"), *measures)
    )


def hourly_daily(hourly: DataFrame, keys: list[str], time: str = "time", delay: str = "6 hours", least_hours: int = 24) -> DataFrame:
    """Hourly weather rows to daily aggregates of all fields; days with fewer readings of any field are left out."""
    return (
        hourly.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, "1 day").alias("_w"))
        .agg(*hourly_aggregates("hours"))
        .filter(F.col("hours") >= least_hours)
        .select(*keys, F.col("_w.start").cast("date").alias("date"), *DAILY_WEATHER, "hours")
    )


def dedup(rows: DataFrame, content: list[str], time: str = "ts", within: str = STABILIZATION) -> DataFrame:
    """Drop repeats of a row's content that arrive within the watermark. Equal rows are equal, so order does not show."""
    digest = F.sha2(F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"}), 256)
    named = rows.withColumn("_digest", digest).withWatermark(time, within)
    return named.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def upsert(rows: DataFrame, write: Callable[[DataFrame], object], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand each micro-batch to an idempotent batch writer, so a replayed batch does no harm."""
    return (
        rows.writeStream.foreachBatch(lambda batch, _: write(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def reconcile(
    outcomes: DataFrame, ledger_path: str, keys: list[str], as_of: Column, checkpoint: str, weeks: int = 4, **trigger
) -> StreamingQuery:
    """Stream of finalized weeks: each micro-batch fills the outcomes of the ledger rows it belongs to.

    Rows written long before their outcome is known are filled when it arrives. A replayed batch
    writes the same values again.
    """

    def fill(batch: DataFrame) -> None:
        ledger = read_ledger(batch.sparkSession, ledger_path)
        hit = ledger.join(batch.select(*keys).distinct(), keys, "left_semi")
        upsert_ledger(attach_truth(hit, batch, keys, as_of, weeks).select(*ledger.columns), ledger_path)

    return upsert(outcomes, fill, checkpoint, **trigger)


def to_parquet(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_to_table(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Drain what is available into a Parquet table and read it back."""
    to_parquet(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def read_folder(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
