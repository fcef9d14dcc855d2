"""From raw documents to packed training sequences.

Five stages, each an operator of ``threadlake.llm`` over all that the stage before kept. A stage
is written as Parquet and read again by the next one, under the session's checkpoint folder. All
stages but the last return the columns of ``documents``; where a stage changes the text, n_chars
(if there is such a column) follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import packing, quality, secret_scan, simhash, substring
from threadlake.llm.common import Scratch, table
from threadlake.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one_each(docs, shingle=3, max_distance=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out. A document that
    loses nothing keeps its text as it is; else the words that stay are joined by one space."""
    out = substring.remove_repeated_windows(docs, width=13)
    text = F.when(F.size("removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(docs, out.withColumn("text", text))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return _with_text(docs, secret_scan.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packs(docs, tokenizer_file("word_bpe_49k.json"), window=2048, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secrets),
    ("packing", pack),
]

#: Fingerprints, tokenizers and retrieval are beyond SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
