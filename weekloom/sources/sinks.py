"""Writers for the state tables. A run that repeats changes nothing.

Tables are Parquet. A replaced table is a new ``snapshot_id`` partition and readers take
the newest, so a failed write leaves the previous snapshot in place. Ledger partitions are
replaced dynamically, only for the issue dates that were written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom import schemas as S
from weekloom.config import cut_lineage
from weekloom.operators import ledger as L
from weekloom.operators import quality as Q
from weekloom.operators.joins import conform
from weekloom.operators.serving import to_json_lines
from weekloom.sources.readers import read_if_present

KEY = ["geography", "week_start_date"]


def _with(schema: T.StructType, *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(n, t) for n, t in extra])


SNAPSHOT = _with(S.CASE_TABLE, ("snapshot_id", T.StringType()))


def read_canonical(spark: SparkSession, path: str, schema: T.StructType = S.CASE_TABLE) -> DataFrame:
    """Newest snapshot of a replaced table."""
    whole = read_if_present(spark, path, _with(schema, ("snapshot_id", T.StringType())))
    newest = whole.agg(F.max("snapshot_id")).first()[0]
    return whole.filter(F.col("snapshot_id") == F.lit(newest)).drop("snapshot_id")


def write_canonical(
    new: DataFrame, path: str, snapshot_id: str, revisions_path: str | None = None, allowed_loss: float = 0.10
) -> dict:
    """Replace the weekly table when its contents changed; log new and revised weeks.

    ``snapshot_id`` must sort after earlier ones (a UTC time stamp does). The retrieval time
    is no content. A series that loses more than the allowed share of rows refuses all.
    """
    spark = new.sparkSession
    Q.require_columns(new, S.CASE_COLUMNS)
    fresh = cut_lineage(conform(new, S.CASE_TABLE))
    Q.require_empty(Q.duplicate_keys(fresh, KEY), "duplicate series weeks")
    old = read_canonical(spark, path)
    Q.require_empty(
        Q.row_loss(old, fresh, ["geography"], allowed_loss).filter("NOT accepted"), "the snapshot lost too many rows"
    )
    if L.snapshot_equal(old, fresh, ["retrieved_at_utc"]):
        return {"replaced": False, "events": 0}
    events = cut_lineage(L.revision_events(old, fresh, KEY))
    if revisions_path:  # first: a run that ends in between is repeated, and then finds its events stored
        stamped = events.withColumn("snapshot_id", F.lit(snapshot_id))
        stored = read_if_present(spark, revisions_path, stamped.schema).filter(F.col("snapshot_id") == snapshot_id)
        if stored.isEmpty():
            append_log(stamped, revisions_path)
    fresh.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(path)
    return {"replaced": True, "events": events.count()}


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert_ledger(new: DataFrame, path: str) -> None:
    """Append predictions; the last row of a key wins. Only touched issue dates are rewritten.

    The merged rows are checkpointed first because they read the partitions they replace. Rows are
    gathered by issue date, and the one large date of a weekly run is split over tasks.
    """
    spark = new.sparkSession
    fresh = cut_lineage(conform(new, S.LEDGER))
    touched = fresh.select("as_of_date").distinct()
    existing = read_if_present(spark, path, S.LEDGER).join(touched, "as_of_date", "left_semi")
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    merged = cut_lineage(L.keep_last(tagged, S.LEDGER_KEY, ["_new", "generated_at_utc"]).drop("_new"))
    (
        merged.hint("rebalance", "as_of_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of_date")
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_if_present(spark, path, S.LEDGER)


def write_vintages(rows: DataFrame, path: str, identity: str = "vintage_id") -> None:
    """Add rows of content not stored yet; known identities are left untouched."""
    spark = rows.sparkSession
    known = read_if_present(spark, path, rows.schema).select(identity).distinct()
    rows.join(known, identity, "left_anti").write.mode("append").parquet(path)


def current_vintages(cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vintage_id): the content identity of each series' table as it is; the retrieval time is no content."""
    hashed = [c for c in S.CASE_COLUMNS if c != "retrieved_at_utc"]
    return L.content_hash(conform(cases, S.CASE_TABLE), keys, hashed).select(*keys, "vintage_id")


def write_case_vintage(cases: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Store each series' table under its content identity, once."""
    keys = keys or ["geography"]
    write_vintages(conform(cases, S.CASE_TABLE).join(current_vintages(cases, keys), keys), path)


def write_validation_rows(parts: list[DataFrame], path: str) -> None:
    """Held-out rows of all variants, range-sorted by variant and week."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole.orderBy("forecast_variant", "week_start_date").write.mode("overwrite").parquet(path)


def write_alerts(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_serving_json(snapshot: DataFrame, path: str) -> None:
    """One JSON document per series and line; NULL fields are left out, NaN never appears."""
    to_json_lines(snapshot).write.mode("overwrite").text(path)
