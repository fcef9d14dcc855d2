"""Queries: curation log (W1-W4, F9, F10, J9, U2, J5, A9) and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake import functions as tf
from threadlake.operators import curation as cu
from threadlake.operators import extract as ex
from threadlake.operators import index as ix
from threadlake.operators import integrity as ig
from threadlake.plans import bindings as b
from threadlake.plans.catalog import register


@b.memo
def _thread_files(spark, sf):
    """Extracted thread files with their novelty verdict against the stored index."""
    from threadlake.plans.q_threads import files_table

    f = files_table(spark, sf)
    cand = f.select("thread_nr", "post_nr", "pos", "file_key", "file_name_4ch", "file_name_orig",
                    F.col("file_ext").alias("ext"), tf.size_text_mb(F.col("file_size")).alias("size_mb"),
                    F.col("file_md5_b64").alias("md5_b64"))
    return ix.novel(cand, ix.build_index(b.index_media(spark, sf)))


def _events(spark, sf):
    return cu.drop_repeats(b.curation_events(spark, sf))


def _fold(spark, sf, events=None):
    ev = b.curation_events(spark, sf) if events is None else events
    return cu.fold_curation(ev, b.sessions(spark, sf), _thread_files(spark, sf))


@register("drop_repeats")
def q_drop_repeats(spark, sf):
    return _events(spark, sf).select("session_id", "seq", "value")


@register("curation_fold")
def q_curation_fold(spark, sf):
    return _fold(spark, sf)


@register("curation_counts")
def q_curation_counts(spark, sf):
    return cu.curation_counts(_fold(spark, sf), _events(spark, sf))


@register("selected_files")
def q_selected_files(spark, sf):
    return cu.selected_files(_fold(spark, sf))


def _threads_unique(spark, sf):
    return b.threads(spark, sf).select("thread_nr", "board", (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("unique_only"))


@register("select_all")
def q_select_all(spark, sf):
    return cu.select_all(_thread_files(spark, sf), _threads_unique(spark, sf))


@register("selection_join")
def q_selection_join(spark, sf):
    return cu.selection_join(_events(spark, sf), b.sessions(spark, sf), _thread_files(spark, sf)).select(
        "session_id", "seq", "file_key", "post_nr", "known")


@register("unknown_urls")
def q_unknown_urls(spark, sf):
    """J9 audit: copied file URLs that name no file of the session's thread."""
    return cu.unknown_urls(_events(spark, sf), b.sessions(spark, sf), _thread_files(spark, sf)).select(
        "session_id", "seq", "file_key")


def _half(spark, sf):
    return b.curation_events(spark, sf).agg((F.max("seq") / 2).cast("bigint")).scalar()


def _prior_fold(spark, sf):
    """The first half of the log, folded once and kept as a table: what a resumed run finds."""
    from threadlake.sources.materialize import input_signature, table_path
    from threadlake.streaming.curation import continue_fold, fold_table

    key = f"{b.BINDINGS_VERSION}|{b.code_tag()}|{sf}|" + input_signature(spark, [f"{sf.rstrip('/')}/{t}.parquet" for t in ("events", "documents", "conversations")])
    path = table_path(spark, "prior-fold", key)
    ev = b.curation_events(spark, sf)
    continue_fold(path, ev.where(F.col("seq") < _half(spark, sf)), b.sessions(spark, sf), _thread_files(spark, sf), ("prior", 0))
    return fold_table(spark, path).read()


@register("selection_resume")
def q_selection_resume(spark, sf):
    """The stored selection united with that of a new run over the second half of the log. The
    new run starts afresh but for the last copied value."""
    from threadlake.streaming.curation import decisions_of, states_of

    prior = _prior_fold(spark, sf)
    afresh = states_of(prior).withColumn("toggles", F.lit(0)).withColumn("open", F.lit(None).cast(prior.schema["state"].dataType["open"].dataType))
    new = b.curation_events(spark, sf).where(F.col("seq") >= _half(spark, sf))
    new = cu.selection_of(cu.fold_stretch(new, b.sessions(spark, sf), _thread_files(spark, sf), afresh)[0])
    return cu.resume_selection(cu.selection_of(decisions_of(prior)), new)


@register("fold_continue")
def q_fold_continue(spark, sf):
    """The second half of the log folded onto the stored summary of the first equals the
    fold of the whole log; only the new half is read."""
    from threadlake.streaming.curation import decisions_of, states_of

    prior = _prior_fold(spark, sf)
    new = b.curation_events(spark, sf).where(F.col("seq") >= _half(spark, sf))
    decisions, _ = cu.fold_stretch(new, b.sessions(spark, sf), _thread_files(spark, sf), states_of(prior))
    return cu.selection_of(cu.later_decisions(decisions_of(prior), decisions))


@register("session_folders")
def q_session_folders(spark, sf):
    default = b.sessions(spark, sf).select(
        "session_id", F.concat(F.element_at(F.array(*[F.lit(x) for x in b.BOARDS]),
                                            (F.pmod(F.col("session_id"), F.lit(4)) + 1).cast("int")),
                               F.lit("_"), F.col("session_id").cast("string")).alias("folder_name"))
    return cu.session_folders(_events(spark, sf), default)


@register("request_lookup")
def q_request_lookup(spark, sf):
    """Files listed on a decorated page -> new, or where the stored copies are
    (extension from the displayed name, size from the displayed size text)."""
    req = ex.extract_requests(b.thread_pages_table(spark, sf, "decorated"))
    _, ext = tf.split_name_ext(F.trim(F.col("name")))
    cand = req.select("file_id", ext.alias("ext"), tf.size_text_mb(F.col("size_text")).alias("size_mb"), "md5_b64")
    return ix.lookup_duplicates(cand, ix.build_index(b.index_media(spark, sf))).select(
        "file_id", "ext", "size_mb", "md5_b64", "n_copies", "first_path", "is_new")


@register("fetch_outcomes")
def q_fetch_outcomes(spark, sf):
    """The thread's whole course: curated selection -> fetch log verdicts -> routes, and the
    manifest line of each fetched file (its declared digest, even when it failed)."""
    from threadlake.operators.manifest import manifest_line

    sel = _fold(spark, sf).where(F.col("to_download"))
    files = _thread_files(spark, sf).select("thread_nr", "file_key", "file_name_4ch", "ext", "md5_b64")
    res = ig.resolve_attempts(b.attempts(spark, sf)).withColumnRenamed("file_key", "attempt_key")
    folders = b.threads(spark, sf).select("thread_nr", "folder_name")
    x = (sel.join(files, ["thread_nr", "file_key"])
         .withColumn("attempt_key", (F.col("file_name_4ch").cast("bigint") - b.NAME_4CH_BASE).cast("string"))
         .join(res, "attempt_key", "left")
         .join(folders, "thread_nr"))
    routed = ig.route_outcomes(x)
    line = manifest_line(tf.b64_to_hex(F.col("md5_b64")),
                         F.format_string("%s/%s.%s", "folder_name", "dl_filename", "ext"))
    return routed.select("session_id", "thread_nr", "file_key", "dl_filename", "n_attempts", "dl_success",
                         "md5_match", "to_report", "to_index", "to_quarantine",
                         F.when(F.col("to_report"), line).alias("manifest_line"))


@register("resume_pending")
def q_resume_pending(spark, sf):
    t = _threads_unique(spark, sf)
    run_state = b.threads(spark, sf).select("board", "thread_nr", (F.pmod(F.col("conv_id"), F.lit(3)) == 0).alias("done"))
    sel = cu.select_all(_thread_files(spark, sf), t).join(t.select("thread_nr", "board"), "thread_nr")
    return cu.pending_threads(t.select("board", "thread_nr"), run_state, sel)


@register("index_upsert")
def q_index_upsert(spark, sf):
    """A2: verified fetches of candidate files are appended to the stored index."""
    res = ig.resolve_attempts(b.attempts(spark, sf))
    ok = res.where(F.col("dl_success") & F.col("md5_match")).select(F.col("file_key").cast("bigint").alias("doc_id"))
    verified = b.candidates(spark, sf).withColumnRenamed("cand_id", "doc_id").join(ok, "doc_id").join(
        b.media(spark, sf).select("doc_id", "size_bytes", "path"), "doc_id")
    new_index, _ = ix.upsert_index(ix.build_index(b.index_media(spark, sf)),
                                   verified.select("ext", "size_bytes", "md5_b64", "path"))
    return new_index


@register("curation_stream")
def q_curation_stream(spark, sf):
    """The same fold as ``curation_fold``, run over the log as it arrives in three parts. After
    each part the stream is drained and starts again from its checkpoint."""
    import uuid

    from threadlake.sources.materialize import table_path
    from threadlake.streaming.curation import run_curation_stream

    run = table_path(spark, f"curation-stream-{uuid.uuid4().hex}", sf)
    log = b.curation_events(spark, sf).select("session_id", "seq", "value")
    most = log.agg(F.max("seq")).scalar()
    part = F.least(F.floor(F.col("seq") * 3 / (most + 1)), F.lit(2))
    for i in range(3):
        log.where(part == i).write.mode("append").parquet(f"{run}/log")
        out = run_curation_stream(spark, f"{run}/log", b.sessions(spark, sf), _thread_files(spark, sf), f"{run}/sink", f"{run}/checkpoint")
    return out


@register("live_novelty")
def q_live_novelty(spark, sf):
    """Thread files arriving as a stream, each flagged new or seen against the stored
    index as it is at each micro-batch, drained with ``availableNow`` into a Parquet sink."""
    import uuid

    from threadlake.sources.materialize import input_signature, materialize, table_path
    from threadlake.streaming.index import live_novelty

    key = f"{b.BINDINGS_VERSION}|{b.code_tag()}|{sf}|" + input_signature(
        spark, [f"{sf.rstrip('/')}/{t}.parquet" for t in ("conversations", "documents")])
    cols = ["thread_nr", "file_key", "ext", "size_mb", "md5_b64"]
    staged = materialize(spark, lambda: _thread_files(spark, sf).select(*cols), "arriving-files", key)
    run = table_path(spark, f"live-novelty-{uuid.uuid4().hex}", sf)
    stream = spark.readStream.schema(staged.schema).parquet(table_path(spark, "arriving-files", key))
    live_novelty(stream, lambda: ix.build_index(b.index_media(spark, sf)), f"{run}/sink", f"{run}/ck",
                 ["thread_nr", "file_key", "is_new"]).awaitTermination()
    return spark.read.parquet(f"{run}/sink").select("thread_nr", "file_key", "is_new")


def _arriving_media(spark, sf, files_at_once=None):
    """All media files staged as a folder that a stream reads."""
    from threadlake.sources.materialize import input_signature, materialize, table_path

    key = f"{b.BINDINGS_VERSION}|{b.code_tag()}|{sf}|" + input_signature(spark, [f"{sf.rstrip('/')}/documents.parquet"])
    staged = materialize(spark, lambda: ix.build_index(b.media(spark, sf)), "arriving-media", key)
    reader = spark.readStream.schema(staged.schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(table_path(spark, "arriving-media", key))


@register("index_upkeep")
def q_index_upkeep(spark, sf):
    """T4/T5: verified files arriving as a stream are appended to the index; it is read back."""
    import uuid

    from threadlake.sources.materialize import table_path
    from threadlake.streaming.index import current_index, maintain_index

    run = table_path(spark, f"index-upkeep-{uuid.uuid4().hex}", sf)
    maintain_index(_arriving_media(spark, sf, 4), f"{run}/index", f"{run}/ck").awaitTermination()
    return current_index(spark, f"{run}/index")


@register("stream_dedupe")
def q_stream_dedupe(spark, sf):
    """One row per digest key of the arriving files, whenever each arrives."""
    import uuid

    from threadlake.sources.materialize import table_path
    from threadlake.streaming.index import digest_table, distinct_digests

    run = table_path(spark, f"stream-dedupe-{uuid.uuid4().hex}", sf)
    distinct_digests(_arriving_media(spark, sf, 4), f"{run}/digests", f"{run}/ck").awaitTermination()
    return digest_table(spark, f"{run}/digests").read().select(*ix.INDEX_KEYS)


@register("run_state")
def q_run_state(spark, sf):
    """The run state of every thread, written and read back."""
    import uuid

    from threadlake.sources.index_store import load_run_state, save_run_state
    from threadlake.sources.materialize import table_path

    path = table_path(spark, f"run-state-{uuid.uuid4().hex}", sf)
    done = F.pmod(F.col("conv_id"), F.lit(3)) == 0
    save_run_state(b.threads(spark, sf).select(
        "board", "thread_nr", F.when(done, F.lit("done")).otherwise(F.lit("curate")).alias("stage"), done.alias("done")), path)
    return load_run_state(spark, path)


@register("manifest_append")
def q_manifest_append(spark, sf):
    """The lines of fetched files appended to a manifest in two runs, read back."""
    import uuid

    from threadlake.operators.manifest import append_manifest, read_manifest
    from threadlake.plans.q_integrity import fetched_media
    from threadlake.sources.materialize import table_path

    path = table_path(spark, f"manifest-{uuid.uuid4().hex}", sf)
    out = fetched_media(spark, sf)
    for part in (0, 1):
        append_manifest(out.where(F.pmod(F.col("doc_id"), F.lit(2)) == part), path)
    return read_manifest(spark, path).select("md5_hex", "path")
