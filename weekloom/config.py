"""Policy values of the weekly job and where a session keeps its working files."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Guardrails:
    """How much worse than the champion a candidate may be."""

    precision_tolerance: float = 0.03
    recall_tolerance: float = 0.03
    pr_auc_tolerance: float = 0.02
    brier_tolerance: float = 0.02
    case_mae_relative_tolerance: float = 0.10
    outbreak_mae_relative_tolerance: float = 0.15
    persistence_relative_tolerance: float = 0.05


@dataclass(frozen=True)
class Policy:
    """Versioned operating policy; the defaults are the published ones."""

    label_stabilization_weeks: int = 4
    minimum_new_finalized_weeks: int = 13
    target_recall: float = 0.8
    prediction_weeks_ahead: int = 1
    minimum_report_age_weeks: int = 4
    maximum_report_age_weeks: int = 12
    validation_report_age_weeks: int = 8
    guardrails: Guardrails = field(default_factory=Guardrails)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def on_shared_disk(folder: str, local: bool) -> str:
    """``folder`` itself, if executors of several machines can share it."""
    if not local and folder.startswith("file:"):
        raise ValueError(f"{folder} is local to one machine; set spark.checkpoint.dir to a folder that all executors see")
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder of working tables: the one the cluster names in spark.checkpoint.dir, as it is.

    Where none is named, a folder below the home folder of the cluster's default file system; on
    one machine a temporary one. A default file system that is local is refused on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    local = is_local(spark)
    if local:
        made = tempfile.mkdtemp(prefix="weekloom-")
    else:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(hadoop)
        made = on_shared_disk(f"{files.getHomeDirectory().toString()}/.weekloom-{uuid.uuid4().hex}", local)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean_up(spark: SparkSession) -> None:
    """Remove the working tables of this session; results that still read them must be stored before."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


_MADE: dict[str, list[str]] = {}


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one run's tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored_small(df: DataFrame, name: str = "small") -> DataFrame:
    """Stored as Parquet and read again, so that Spark knows the real size of a small side of a join."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
