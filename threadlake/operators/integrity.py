"""Fetch outcomes and integrity.

Fetching itself is not table work; its log enters as ``attempts(file_key, n, dl_success,
md5_match, ...)`` and everything after it is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import b64_to_hex, digest_equal

# Fixed value: retries after the first attempt.
RETRIES = 1


def resolve_attempts(attempts: DataFrame, retries: int = RETRIES, key: str = "file_key") -> DataFrame:
    """The retry loop's verdict per file.

    Attempts ``n = 1..retries+1`` may run; the loop stops after the first digest match.
    Result: ``dl_success`` of the last executed attempt, ``md5_match`` = last non-NULL
    digest verdict among executed attempts (an earlier verdict survives a later failed
    fetch), ``n_attempts``. Only the first ``retries+1`` attempts can matter, so each file
    is one partial aggregate with ``retries+1`` pivoted slots: no window, no sort, and a
    file with an enormous log still combines map-side.
    """
    k_max = retries + 1
    a = attempts.where(F.col("n").between(1, k_max))
    aggs = [F.max("n").alias("_n_max")]
    for k in range(1, k_max + 1):
        aggs.append(F.max(F.when(F.col("n") == k, F.col("dl_success"))).alias(f"_s{k}"))
        aggs.append(F.max(F.when(F.col("n") == k, F.col("md5_match"))).alias(f"_m{k}"))
    g = a.groupBy(key).agg(*aggs)
    first_match = F.coalesce(*[F.when(F.col(f"_m{k}"), F.lit(k)) for k in range(1, k_max + 1)], F.lit(k_max))
    last = F.least(first_match, F.col("_n_max"))
    success = F.coalesce(*[F.when(last == k, F.col(f"_s{k}")) for k in range(1, k_max + 1)])
    match = F.coalesce(*[F.when(F.lit(k) <= last, F.col(f"_m{k}")) for k in range(k_max, 0, -1)])
    return g.select(key, last.cast("bigint").alias("n_attempts"), success.alias("dl_success"), match.alias("md5_match"))


def mark_short_reads(attempts: DataFrame) -> DataFrame:
    """An attempt that received fewer bytes than announced is a failed fetch; where either
    number is unknown it stands as it is."""
    short = F.coalesce(F.col("bytes_received") < F.col("content_length"), F.lit(False))
    return (attempts.withColumn("short_read", short)
            .withColumn("dl_success", F.col("dl_success") & ~short)
            .withColumn("md5_match", F.when(F.col("dl_success"), F.col("md5_match"))))


def route_outcomes(outcomes: DataFrame) -> DataFrame:
    """report + manifest take fetched files; the index takes fetched and verified;
    quarantine takes fetched with a failed digest."""
    s, m = F.coalesce(F.col("dl_success"), F.lit(False)), F.col("md5_match")
    return (outcomes.withColumn("to_report", s)
            .withColumn("to_index", s & F.coalesce(m, F.lit(False)))
            .withColumn("to_quarantine", s & ~F.coalesce(m, F.lit(True))))


def skip_existing(requests: DataFrame, existing: DataFrame, overwrite: bool = False,
                  path_col: str = "path") -> DataFrame:
    """drop requests whose destination already exists, unless ``overwrite``."""
    if overwrite:
        return requests
    return requests.join(existing.select(F.col(path_col)).distinct(), path_col, "left_anti")


def verify_integrity(declared: DataFrame, actual: DataFrame, on: str = "path") -> DataFrame:
    """Declared base64 digest vs actual hex digest of the stored content, per file."""
    return (declared.join(actual, on)
            .withColumn("md5_match", digest_equal(F.col("declared_b64"), F.col("actual_hex"))))


def progress(outcomes: DataFrame, key: str = "thread_nr") -> DataFrame:
    """Processed / fetched / verified counts per thread (partial aggregates)."""
    return outcomes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_processed"),
        F.count_if(F.coalesce(F.col("dl_success"), F.lit(False))).alias("n_fetched"),
        F.count_if(F.coalesce(F.col("dl_success") & F.col("md5_match"), F.lit(False))).alias("n_verified"))


# Fixed value: header of the failure report.
FAILED_HEADER = "Failed MD5s of Thread No. %s:"


def integrity_report(failed: DataFrame, key: str = "thread_nr", item: str = "file_key",
                     order: str = "file_key") -> DataFrame:
    """Per thread a header line and one line per failed file, as ordered rows
    ``(thread_nr, line_key, line)``; ``"\\n".join`` by ``line_key`` gives the report."""
    head = failed.select(key).distinct().select(key, F.lit("0").alias("line_key"),
                                                F.format_string(FAILED_HEADER, F.col(key)).alias("line"))
    body = failed.select(key, F.concat(F.lit("1"), F.col(order).cast("string")).alias("line_key"),
                         F.col(item).cast("string").alias("line"))
    return head.unionByName(body)


def write_failures(lines: DataFrame, out_dir: str) -> None:
    """The text of each thread's failure report under ``thread=<key>/``.

    ``lines``: the rows of ``integrity_report``. They are range-partitioned and sorted by (thread,
    line), so the part files of a thread, read in name order, hold its lines in order; a thread
    with very many failures has several."""
    key = lines.columns[0]
    rows = lines.select(F.col("line").alias("value"), F.col(key).cast("string").alias("thread"), "line_key")
    (rows.repartitionByRange("thread", "line_key").sortWithinPartitions("thread", "line_key").select("value", "thread")
     .write.mode("overwrite").partitionBy("thread").text(out_dir))


def verify_stored(spark, root: str, declared: DataFrame, exts=None) -> DataFrame:
    """J6 over files on disk: list ``root`` (hidden names included), digest the files in the tasks,
    whatever their size, and compare with ``declared(path, declared_b64)``; paths are relative to ``root``.
    Declared files missing on disk come out with ``md5_match = NULL``."""
    from threadlake.functions.urls import VALID_FILE_EXT
    from threadlake.sources.media import list_media, scan_media

    exts = exts or VALID_FILE_EXT
    scan = scan_media(spark, root, exts, listing=list_media(spark, root)).select(
        "path", b64_to_hex(F.col("md5_b64")).alias("actual_hex"))
    return (declared.join(scan, "path", "left")
            .withColumn("md5_match", F.when(F.col("actual_hex").isNotNull(),
                                            digest_equal(F.col("declared_b64"), F.col("actual_hex")))))
