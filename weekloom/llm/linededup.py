"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

Documents come in batches of descending id. A batch's line hashes meet the stored runs in merge
joins: a hash that no run holds is new, and the batch's largest document becomes its holder; a
hash that is known only adds to its number of documents. The outcome is written as a new run,
bucketed and sorted by hash, so that later joins read runs without shuffling them. When a level
holds ``fanout`` runs, they are merged into one run of the next level.

Hashes are MD5 digests of the line keys, so the runs have 16 bytes a line whatever its length.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import remove, working_path
from weekloom.llm.common import arrow_map, id_text, partitions, stored

SALTS = 16


def line_key(line: str) -> bytes:
    """The line without spaces at its ends, A-Z lower-cased."""
    return line.encode("utf-8", "surrogatepass").strip().lower()


def line_hash(line: str, min_chars: int) -> bytes | None:
    """Digest of the key; None for keys that are too short to count."""
    key = line_key(line)
    if len(key) < min_chars or len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return hashlib.md5(key).digest()


def _hasher(min_chars: int):
    def of_batch(batch):
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {h for line in text.split("\n") if (h := line_hash(line, min_chars))}
            hashes.extend(found)
            ids.extend([doc] * len(found))
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, batch.column(0).type)], ["h", "doc_id"])

    return of_batch


class LineRuns:
    """Runs of (h, n_docs, holder) in bucketed tables by level; their files lie in the shared folder, not in the warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = partitions(spark)
        self.levels: dict[int, list[str]] = {}
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [name for names in self.levels.values() for name in names]

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row per hash with n_docs and the batch's largest document ``holder``."""
        rows, known = batch, F.lit(False)
        for i, name in enumerate(self.runs()):
            run = self.spark.table(name).select(F.col("h").alias("_h"), F.lit(True).alias(f"_in{i}"))
            rows = rows.join(run.hint("merge"), F.col("h") == F.col("_h"), "left").drop("_h")
            known = known | F.coalesce(F.col(f"_in{i}"), F.lit(False))
        rows = rows.select("h", "n_docs", F.when(~known, F.col("holder")).alias("holder"))
        self._write(rows, 0)

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = working_path(self.spark, name)
        rows.repartition(self.buckets, "h").write.option("path", path).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.paths[name] = path
        self.levels.setdefault(level, []).append(name)
        full = self.levels[level]
        if len(full) >= self.fanout:
            self.levels[level] = []
            self._write(self._merged(full), level + 1)
            self._drop(full)

    def _merged(self, names: list[str]) -> DataFrame:
        # Spark takes a union of bucketed tables for parted by bucket, which it is not, and drops even a named exchange: a
        # hash of two runs would come out of the grouping twice. So the files are read as plain Parquet.
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self.spark.table(n).schema).parquet(self.paths[n]) for n in names])
        return rows.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def entries(self) -> DataFrame:
        """One row per hash with the documents that hold it and the holder of the first batch."""
        return self._merged(self.runs())

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = {}


SAMPLE = 1000


def _cuts(lines: DataFrame, batches: int) -> list:
    """Ids, of any type that has an order, that part the documents into about equal batches: from ``SAMPLE`` rows by hash."""
    drawn = lines.select("doc_id").orderBy(F.xxhash64("h", "doc_id")).limit(SAMPLE).collect()
    ids = sorted(r[0] for r in drawn)
    return sorted({ids[len(ids) * i // batches] for i in range(1, batches)}) if ids else []


def shared_line_hashes(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """One row per document that loses lines: doc_id and the hashes of the lines that go."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    lines = docs.where("doc_id IS NOT NULL").mapInArrow(arrow_map(_hasher, min_chars), f"h binary, doc_id {kind}")
    lines = stored(lines.distinct(), "lines")
    # Cut points only set the size of the batches, not the result.
    bounds = [None, *_cuts(lines, batches), None]
    runs = LineRuns(spark, fanout)
    try:
        for low, high in reversed(list(zip(bounds, bounds[1:], strict=False))):
            part = lines
            if low is not None:
                part = part.where(F.col("doc_id") >= low)
            if high is not None:
                part = part.where(F.col("doc_id") < high)
            runs.add(part.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder")))
        shared = runs.entries().where(F.col("n_docs") >= min_docs).select("h", "holder")
        # A line may stand in a third of all documents: its rows are salted, the few shared hashes repeated.
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        gone = salted.join(shared, ["h", "salt"]).where(F.col("doc_id") != F.col("holder"))
        return stored(gone.groupBy("doc_id").agg(F.collect_list("h").alias("gone")), "gone")
    finally:
        runs.close()


def _with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows with the hashes of the lines that they lose. Rows without an id lose none and stay out of the join."""
    # Texts always meet their lines in one exchange, however few documents lose any.
    named = rows.where("doc_id IS NOT NULL").join(gone.hint("merge"), "doc_id", "left")
    return named.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True).select(*rows.columns, "gone")


def kept_lines(text: str, gone, min_chars: int) -> str:
    if not gone:
        return text
    out = set(gone)
    return "\n".join(line for line in text.split("\n") if line_hash(line, min_chars) not in out)


def _cutter(min_chars: int):
    def of_batch(batch):
        texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.split("\n")
            kept = lines
            if gone:
                out = set(gone)
                kept = [line for line in lines if line_hash(line, min_chars) not in out]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append("\n".join(kept))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text"],
        )

    return of_batch


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents stay only in the
    largest document that holds them. A null or empty text is one empty line. Rows that share an id
    are one document when documents are counted. Rows with a null id lose nothing and are not
    counted. Columns other than the two named are not read.
    """
    rows = id_text(docs, id_col, text_col)
    gone = shared_line_hashes(rows, min_chars, min_docs, batches, fanout)
    kind = dict(rows.dtypes)["doc_id"]
    return _with_gone(rows, gone).mapInArrow(
        arrow_map(_cutter, min_chars), f"doc_id {kind}, n_lines long, n_dropped long, kept_text string"
    )


def _text_cutter(min_chars: int):
    def of_batch(batch):
        names = [n for n in batch.schema.names if n != "gone"]
        texts = [
            kept_lines(text or "", gone, min_chars)
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)
        ]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return of_batch


def deduplicated_documents(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """The documents, all columns as they are, with the lines that go cut out of ``text``."""
    gone = shared_line_hashes(id_text(docs), min_chars, min_docs, batches, fanout)
    joined = _with_gone(docs, gone).select(*docs.columns, "gone")
    return joined.mapInArrow(arrow_map(_text_cutter, min_chars), docs.schema)
