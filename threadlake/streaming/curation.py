"""Live curation over a stream of log rows, by summaries that continue each other.

Each micro-batch is one stretch of the log. It is folded as the batch job folds a whole log
(``operators.curation.fold_stretch``: blocks of rows, partial aggregates, so a session with a large
share of the rows is spread over tasks), continuing the summaries of its sessions that the batches
before left in a versioned table. The summary of a session is its last value, its toggles' parity
and the file still open, never its history; decisions on files are one row each. Both are appended
in one commit per batch, so a batch replayed after a failure counts once, and the table merges its
commits as they come together, keeping the latest row of each key.

A session's rows have to arrive in the order of ``seq`` from batch to batch (within a batch any
order will do). A row that arrives later than that is not folded; it goes to the table of late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.curation import DECISION, STATE, fold_stretch, selection_of
from threadlake.session import cut_lineage
from threadlake.sources.versions import VersionedTable

LOG_DDL = "session_id BIGINT, seq BIGINT, value STRING"
#: A session's summary (file_key NULL) or a decision on a file.
FOLD_DDL = f"session_id BIGINT, file_key STRING, at BIGINT, batch BIGINT, state STRUCT<{STATE}>, decision STRUCT<{DECISION}>"


def _latest(rows: DataFrame) -> DataFrame:
    """The latest row of each key: of a file the last epoch's, and of that the last batch's."""
    best = F.max_by(F.struct("at", "batch", "state", "decision"), F.struct("at", "batch"))
    return rows.groupBy("session_id", "file_key").agg(best.alias("r")).select("session_id", "file_key", "r.*")


def fold_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, f"{path.rstrip('/')}/fold", FOLD_DDL, sort_by=["session_id", "file_key"], merge=_latest)


def late_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, f"{path.rstrip('/')}/late", LOG_DDL)


def states_of(rows: DataFrame) -> DataFrame:
    """The summaries of the sessions: (session_id, <STATE>)."""
    return _latest(rows.where(F.col("file_key").isNull())).select("session_id", "state.*")


def decisions_of(rows: DataFrame) -> DataFrame:
    return _latest(rows.where(F.col("file_key").isNotNull())).select("session_id", "file_key", "decision.*")


def continue_fold(path: str, events: DataFrame, sessions: DataFrame, files: DataFrame, batch: tuple[str, int],
                  blocks: int | None = None) -> None:
    """Fold a stretch ``events(session_id, seq, value)`` onto what the tables at ``path`` hold, in
    one commit. ``batch``: (writer, number); one that was committed before is left out."""
    spark = events.sparkSession
    fold, late = fold_table(spark, path), late_table(spark, path)
    now = fold.latest()
    if now.batches.get(batch[0], -1) >= batch[1]:
        return
    events = cut_lineage(events.select("session_id", "seq", "value"))
    before = fold.read(now).where(F.col("file_key").isNull()).join(events.select("session_id").distinct(), "session_id", "left_semi")
    before = cut_lineage(states_of(before))
    seen = events.join(before.select("session_id", "last_seq"), "session_id", "left")
    in_time = F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))
    late.append(seen.where(~in_time).select("session_id", "seq", "value"), batch)
    decisions, states = fold_stretch(seen.where(in_time).select("session_id", "seq", "value"), sessions, files, before, blocks)
    packed = lambda df, but: F.struct(*[c for c in df.columns if c not in but])
    own = decisions.select("session_id", "file_key", F.col("epoch_seq").alias("at"), packed(decisions, ("session_id", "file_key")).alias("decision"))
    summaries = states.select("session_id", F.lit(0).cast("bigint").alias("at"), packed(states, ("session_id",)).alias("state"))
    rows = own.unionByName(summaries, allowMissingColumns=True).withColumn("batch", F.lit(now.number).cast("bigint"))
    schema = spark.createDataFrame([], FOLD_DDL).schema
    fold.append(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), batch)


def current_selection(spark: SparkSession, path: str) -> DataFrame:
    """The selection as the tables at ``path`` have it now; equals the batch fold of the rows so far."""
    return selection_of(decisions_of(fold_table(spark, path).read()))


def run_curation_stream(spark: SparkSession, events_path: str, sessions: DataFrame, files: DataFrame, sink_path: str,
                        checkpoint: str, schema: str = LOG_DDL, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the live fold over a folder of event files until it is drained (``availableNow``);
    restartable from ``checkpoint`` (T5). Returns the selection."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    (reader.parquet(events_path).writeStream
     .foreachBatch(lambda df, number: continue_fold(sink_path, df, sessions, files, (checkpoint, number)))
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return current_selection(spark, sink_path)
