"""Registered queries of the text operators with production parameters, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import (
    collocations, html_text, jaccard, langid, licenses, linededup, lm, merkle, packing, pieces, prefix_trie, quality, warc,
)
from weekloom.llm import sql_forms
from weekloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), added=packing.added_tokens(vocabulary("byte_bpe_50k.json"))
    )


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk: ids by the vocabulary, and the text that decodes from them."""
    path = vocabulary("piece_bpe_32k.model")
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", "chunk", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), links=False)


@query
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), lm.crc_share("doc_id", 7, 2))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.page_texts(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("first_doc", "first_word")


ORACLES |= {
    "op11_prefix_trie": sql_forms.prefix_trie(),
    "op12_license_scan": sql_forms.license_scan(licenses.template_rows(licenses.TEMPLATES, licenses.PERCENT), licenses.PHRASES),
    "op13_collocations": sql_forms.collocations(),
}
