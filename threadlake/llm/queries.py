"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` each.

Each one applies its operator to the whole of its table; digests are derived from the operator's
results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import ann, bpe, hard_negatives, langid, language_model, packing, quality, secret_scan, simhash, substring, suffix, token_counts, whitening
from threadlake.llm.common import Scratch, table
from threadlake.llm.sql import QUALITY_SQL


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secret_scan.BASE), "base_sha256", secret_scan.listed(F.col("spans")).alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_components(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packs(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), window=2048, end_id=1)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents; revise those whose repeated lines are taken out; delete the toxic ones;
    then the last two batches arrive once more, as after a failed acknowledgement."""
    from public_tokenizers import PATTERN

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    change = lambda df, op, seq: df.withColumns({"tokenizer": F.lit("byte_bpe_50k"), "op": F.lit(op), "seq": F.lit(seq).cast("bigint")})
    scratch = Scratch(spark, "counts")
    book = token_counts.Rollup(spark, f"{scratch.base}/rollup")
    book.commit("1-load", change(token_counts.counted(docs, ranks, PATTERN), "insert", 1))
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    shorter = docs.withColumn("once", once).where(F.length("once") < F.length("text"))
    revised = change(token_counts.counted(shorter.drop("text").withColumnRenamed("once", "text"), ranks, PATTERN), "revise", 2)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    deleted = docs.select("doc_id", "source", "lang").join(toxic, "doc_id", "left_semi").withColumn("n_tokens", F.lit(0).cast("bigint"))
    deleted = change(deleted, "delete", 3)
    for batch, changes in (("2-revise", revised), ("3-delete", deleted), ("2-revise", revised), ("3-delete", deleted)):
        book.commit(batch, changes)
    return book.totals()


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents")).select("doc_id", *quality.BASE_COLUMNS, "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    langs, book = langid.learn(docs.where(~out))
    return langid.predicted(docs.select("doc_id", "text"), langs, book, with_text=False).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, tokenizer_file("byte_bpe_50k.json"), with_text=False, digests=True)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50, with_text=False)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), width=13, with_text=False)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return language_model.scored(table(spark, sf_dir, "documents"), held_out)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scans, op2_simhash, op3_packing, op4_token_counts, op5_neighbours, op6_quality_rules, op7_language_id, op8_bpe, op9_suffix_dedup, op10_substring_dedup, op11_whitening, op12_lm_scores, op13_hard_negatives)
}
ORACLE: dict[str, str] = {"op6_quality_rules": QUALITY_SQL}
