"""Novelty of arriving files, de-dup of verified files, incremental index upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.index import INDEX_KEYS, novel
from threadlake.session import cut_lineage
from threadlake.sources.index_store import INDEX_DDL, load_index
from threadlake.sources.versions import VersionedTable


def novelty_stream(files: DataFrame, index: DataFrame) -> DataFrame:
    """T2 as a stream-static left join: each arriving file is flagged ``is_new`` against the
    index as it was when the stream started. ``live_novelty`` follows a growing index."""
    return novel(files, index)


def live_novelty(files: DataFrame, open_index: Callable[[], DataFrame], out_path: str, checkpoint: str,
                 cols: list[str] | None = None):
    """Flag each arriving file ``is_new`` against the index of that moment.

    ``open_index`` is called for every micro-batch, so files indexed meanwhile are seen. The
    index is first cut down to the batch's keys by a semi join, in which the keys are the
    small side (AQE broadcasts them when their measured size is under its bound): the
    index is scanned, not shuffled or aggregated whole. A batch replaces its own
    ``batch_id`` folder, so a replay leaves each row once.
    """
    def write_batch(df: DataFrame, epoch_id: int) -> None:
        index = open_index()
        near = index.join(df.select(*INDEX_KEYS).distinct(), list(INDEX_KEYS), "left_semi")
        out = novel(df, near)
        (out.select(*(cols or out.columns)).withColumn("batch_id", F.lit(epoch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    return (files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedupe_verified(verified: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """T3 with bounded state: keep the first verified file per ``(ext, size_mb, md5_b64)`` seen
    within the watermark; a digest that comes again later counts as new. ``distinct_digests``
    never forgets."""
    return verified.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(INDEX_KEYS))


def digest_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, INDEX_DDL, sort_by=["ext", "size_mb", "md5_b64"])


def distinct_digests(verified: DataFrame, path: str, checkpoint: str):
    """The first verified file of each ``(ext, size_mb, md5_b64)``, however long ago it was seen.

    The files kept are the state: a versioned table in the shared folder, not the memory of a state
    store. A batch is reduced to one row per digest (the smallest path), and the rows whose digest
    the table lacks are appended; a replayed batch is not appended again. The table is first cut
    down to the batch's digests by a semi join, so it is scanned (key columns only), not shuffled,
    while the batch is small. A null key part matches nothing: such rows have no digest to compare
    and are all kept.
    """
    keys = list(INDEX_KEYS)

    def write_batch(df: DataFrame, epoch_id: int) -> None:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        own = cut_lineage(df.where(known).groupBy(*keys).agg(F.min("path").alias("path")))
        seen = digest_table(df.sparkSession, path).read().select(*keys)
        near = seen.join(own.select(*keys), keys, "left_semi")
        new = own.join(near, keys, "left_anti").select(*keys, "path")
        digest_table(df.sparkSession, path).append(new.unionByName(df.where(~known).select(*keys, "path")), (checkpoint, epoch_id))

    return (verified.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def index_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, INDEX_DDL, partition_by=["ext"], sort_by=["size_mb", "md5_b64"])


def maintain_index(verified: DataFrame, additions_path: str, checkpoint: str, trigger_available_now: bool = True):
    """T4/T5: append each micro-batch of verified files ``(ext, size_mb, md5_b64, path)`` to the
    versioned index at ``additions_path``. Restartable from ``checkpoint``; a batch replayed after
    a failure counts once. Small batches are merged as they come together, so any number of
    batches leaves a bounded number of files, and a reader sees one version of the index."""
    def write_batch(df: DataFrame, epoch_id: int) -> None:
        index_table(df.sparkSession, additions_path).append(df.select(*INDEX_KEYS, "path"), (checkpoint, epoch_id))

    w = verified.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def current_index(spark, additions_path: str, base_path: str | None = None) -> DataFrame:
    """The stream's additions, plus the base snapshot when given."""
    add = index_table(spark, additions_path).read().select(*INDEX_KEYS, "path")
    return add if base_path is None else load_index(spark, base_path).unionByName(add)


def index_counts(index: DataFrame) -> DataFrame:
    return index.groupBy(*INDEX_KEYS).agg(F.count(F.lit(1)).alias("n_paths"))
