"""Corpus pipeline over ``documents``: every stage is one of the operators in ``weekloom.llm``.

Stages take (spark, docs, sf_dir) and work on all that the stage before kept. All but the last
return the columns of ``documents``. Null texts are empty; columns beyond those of ``documents`` are
not read, whatever their names; an empty table stays empty. Rows that repeat an id each go their way, and
rows with a null id are never taken for copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import jaccard, langid, linededup, packing, quality
from weekloom.llm.common import stored
from weekloom.llm.lm import crc_share
from weekloom.llm.queries import split_pattern, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts and texts without a letter) go; ``lang`` becomes the prediction.

    Where nothing can be learned, nothing is rejected.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~crc_share("doc_id", 5, 0)))
    if not model.languages:
        return docs
    found = langid.predict(docs, model, keep_text=True)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too much or fail the base counts."""
    kept = quality.cleaned_documents(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by documents stay in one; documents left without a word go."""
    kept = linededup.deduplicated_documents(docs.select(*COLUMNS))
    kept = kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays."""
    docs = docs.select(*COLUMNS)
    found = jaccard.similarity_components(docs, links=False)
    gone = stored(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    # Rows without an id are no one's copies; they would all meet in one task of the join.
    named = docs.where("doc_id IS NOT NULL").join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)
    return named.unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    added = packing.added_tokens(vocabulary("byte_bpe_50k.json"))
    return packing.best_fit_packing(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), added=added)


STAGES = [
    ("language", language),
    ("quality", clean_lines),
    ("line_dedup", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: Language models, n-gram sets and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
