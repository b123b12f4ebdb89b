"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import working_path

#: Bytes that separate words: space and the controls from tab to carriage return.
#: ``bytes.split()`` and ``bytes.strip()`` without arguments use exactly this set.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CHARS = SPACES.decode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read again: the lineage is cut and the size is known."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text counts as empty."""
    # No alias where the name is right: plans of both sides of a self-join then look alike and share an exchange.
    key = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    return docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(
    make: Callable[..., Callable[[pa.RecordBatch], pa.RecordBatch]], *args, rows_at_once: int | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``make(*args)`` runs once a task and gives the function of a batch.

    Batches are handled ``rows_at_once`` (``ROWS_AT_ONCE``) rows at a time, which bounds what a task holds as objects.
    """
    step = rows_at_once or ROWS_AT_ONCE

    def run(batches):
        of_batch = make(*args)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                out = of_batch(batch.slice(lo, step))
                if out.num_rows:
                    yield out
        del of_batch
        release_memory()

    return run


ROWS_AT_ONCE = 1024


def release_memory() -> None:
    """Give freed memory back to the system: a worker stays with its executor between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go(spark: SparkSession) -> None:
    """Collect garbage on the driver: shuffle and checkpoint files of frames that nothing refers to are deleted then.

    Jobs of many rounds ask for it, as the driver alone would keep the files of all rounds until its heap fills.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()
