"""Curation log -> final selection.

A session is one thread being curated: an ordered log of copied values (file URLs,
commands, free text). The archive tool folds it sequentially; here it is a set of
group-bys:

* ``epoch``  = running count of file-URL rows (each URL copy starts a new epoch and
  resets that file's name and flags);
* ``sub``    = running count of rows that set the name base (URL, reset commands);
* ``tog``    = running count of toggles (parity = use original names).

Running counts use the blockwise prefix sums of ``operators.sequence``, so a session
holding a large share of all events is still spread over many tasks. Only the last
epoch of each (session, file) decides its final state, and a ``remove_file`` in it
deselects the file. Everything else is partial aggregates on (session, epoch) or
(session, file) and joins on those keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import file_key, is_file_url, py_strip, sanitize_name
from threadlake.operators.sequence import dedup_prefix_sums, previous_value
from threadlake.session import cut_lineage

# The commands recognised in the log (compared after trimming).
RENAME = "rename_thread"
TOGGLE = "toggle_use_orig_fn"
RESET = "reset_filename"
RESET_4CH = "reset_to_4ch_fn"
ADD_ANYWAY = "add_anyway"
REMOVE = "remove_file"

KEYS = ["session_id"]


def drop_repeats(events: DataFrame, blocks: int | None = None) -> DataFrame:
    """Drop a value equal to the session's immediately preceding value."""
    x = previous_value(events, KEYS, "seq", "value", "_prev", blocks)
    return x.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("value"))).drop("_prev", "_prev_exists")


def classify(events: DataFrame) -> DataFrame:
    """Kind of each row: url, rename, toggle, reset, reset4ch, add, remove, text."""
    cmd = py_strip(F.col("value"))
    kind = (F.when(is_file_url(F.col("value")), F.lit("url"))
            .when(cmd == RENAME, F.lit("rename"))
            .when(cmd == TOGGLE, F.lit("toggle"))
            .when(cmd == RESET, F.lit("reset"))
            .when(cmd == RESET_4CH, F.lit("reset4ch"))
            .when(cmd == ADD_ANYWAY, F.lit("add"))
            .when(cmd == REMOVE, F.lit("remove"))
            .otherwise(F.lit("text")))
    return events.withColumn("kind", kind).withColumn(
        "file_key", F.when(F.col("kind") == "url", file_key(F.col("value"))))


DECISION = ("epoch_seq BIGINT, thread_nr STRING, unique_only BOOLEAN, file_name_4ch STRING, file_name_orig STRING, "
            "is_new BOOLEAN, base_kind STRING, base_tog INT, suffix STRING, added BOOLEAN, removed BOOLEAN")
STATE = f"last_seq BIGINT, last_value STRING, toggles INT, open STRUCT<file_key STRING, {DECISION}>"
_FIELDS = [f.split()[0] for f in DECISION.split(", ")]
_CARRY = "carry"  # the kind of the row that stands for the log before a stretch


def _numbered(events: DataFrame, carry: DataFrame | None, blocks: int | None) -> DataFrame:
    """The log without repeats: (session_id, seq, kind, file_key, text, epoch, tog, sub)."""
    cols = ["session_id", "seq", "value", "kind", "file_key"]
    c = classify(events).select(*cols)
    if carry is not None:
        c = c.unionByName(carry.select("session_id", F.col("last_seq").alias("seq"), F.col("last_value").alias("value"),
                                       F.lit(_CARRY).alias("kind"), F.lit(None).cast("string").alias("file_key")))
    c = dedup_prefix_sums(c, KEYS, "seq", "value", {
        "epoch": (F.col("kind") == "url").cast("int"),
        "tog": (F.col("kind") == "toggle").cast("int"),
        "sub": F.col("kind").isin("url", "reset", "reset4ch").cast("int"),
    }, blocks)
    text = F.when(F.col("kind") == "text", F.col("value")).alias("text")
    return c.select("session_id", "seq", "kind", "file_key", text, "epoch", "tog", "sub")


def fold_stretch(events: DataFrame, sessions: DataFrame, files: DataFrame, carry: DataFrame | None = None,
                 blocks: int | None = None, cut: bool = True) -> tuple[DataFrame, DataFrame]:
    """The summary of a stretch of the log, which continues the summary ``carry`` of what came
    before it: ``(decisions, states)``.

    ``decisions(session_id, file_key, <DECISION>)``: for each file whose URL is copied in the
    stretch, or that was open when it began, what its last epoch says. ``states(session_id,
    <STATE>)``: for each session of the stretch all that a later stretch needs: the last value (for
    repeats), the parity of toggles, and the file still open with its name so far. Folding a log in
    one stretch or in any number of consecutive ones gives the same decisions, the later ones (by
    ``epoch_seq``, then by stretch) standing for the earlier. ``carry`` has one row per session that
    has been seen before (states of other sessions do no harm); the stretch's rows come after its
    ``last_seq``.

    Only an epoch that decides a file needs its texts, and of these only those after its last name
    base: they are joined with the few deciding epochs, on a key that AQE can split, and collected
    to what is the file's name.
    """
    if carry is not None:
        carry = carry.join(events.select("session_id").distinct(), "session_id", "left_semi")
        carry = cut_lineage(carry) if cut else carry
    c = _numbered(events, carry, blocks)
    if carry is None:
        c = c.where(F.col("epoch") > 0)
    if cut:
        c = cut_lineage(c)

    # Each epoch without its texts (one partial aggregate straight from the log, so an epoch with
    # very many rows arrives as one row per task). Rows after a remove only matter when there is
    # none: a removed file is not selected whatever else its epoch holds. Epoch 0 goes on with
    # the file that was open.
    is_base = F.col("kind").isin("url", "reset", "reset4ch")
    epochs = c.groupBy("session_id", "epoch").agg(
        F.max_by(F.struct("kind", "tog"), F.when(is_base, F.col("seq"))).alias("base"),
        F.max("sub").alias("last_sub"),
        F.max("file_key").alias("file_key"),
        F.max(F.when(F.col("kind") == "url", F.col("seq"))).alias("epoch_seq"),
        F.max("tog").alias("tog"),
        F.max(F.col("kind") == "add").alias("added"),
        F.max(F.col("kind") == "remove").alias("removed"))
    s = sessions.select("session_id", "thread_nr", "unique_only")
    f = files.select("thread_nr", "file_key", "file_name_4ch", "file_name_orig", "is_new")
    known = epochs.where(F.col("epoch") > 0).join(s, "session_id").join(f, ["thread_nr", "file_key"])
    attrs = ["epoch", "epoch_seq", "last_sub", "thread_nr", "unique_only", "file_name_4ch", "file_name_orig", "is_new", "base", "added", "removed"]
    known = known.groupBy("session_id", "file_key").agg(F.max_by(F.struct(*attrs), F.col("epoch")).alias("e"))
    known = known.select("session_id", "file_key", *[F.col(f"e.{a}").alias(a) for a in attrs if a != "base"],
                         F.col("e.base.kind").alias("base_kind"), F.col("e.base.tog").alias("base_tog"), F.lit(None).cast("string").alias("begun"))
    if carry is not None:
        # Toggles count on from the sessions' parity; epoch 0 has what the open file already had.
        before = carry.select("session_id", "toggles", "open")
        known = known.join(before.select("session_id", "toggles"), "session_id", "left").withColumn(
            "base_tog", F.col("base_tog") + F.coalesce("toggles", F.lit(0))).drop("toggles")
        o = epochs.where(F.col("epoch") == 0).join(before.where(F.col("open").isNotNull()), "session_id")
        anew = F.col("base").isNotNull()
        gone_on = o.select(
            "session_id", F.col("open.file_key").alias("file_key"), "epoch", F.col("open.epoch_seq").alias("epoch_seq"), "last_sub",
            *[F.col(f"open.{a}").alias(a) for a in ("thread_nr", "unique_only", "file_name_4ch", "file_name_orig", "is_new")],
            (F.col("added") | F.col("open.added")).alias("added"), "removed",
            F.when(anew, F.col("base.kind")).otherwise(F.col("open.base_kind")).alias("base_kind"),
            F.when(anew, F.col("base.tog") + F.col("toggles")).otherwise(F.col("open.base_tog")).alias("base_tog"),
            F.when(~anew, F.col("open.suffix")).alias("begun"))
        known = known.unionByName(gone_on)
    if cut:
        known = cut_lineage(known)

    # The names' texts: an inner join on one struct, so that AQE can split an epoch with very many
    # texts, then collected beside the epochs themselves.
    key = F.struct("session_id", "epoch", F.col("last_sub").alias("sub")).alias("_key")
    text = c.where(F.col("text").isNotNull()).select(
        F.struct("session_id", "epoch", "sub").alias("_key"), F.struct("seq", sanitize_name(py_strip(F.col("text"))).alias("s")).alias("t"))
    own = [x for x in known.columns if x not in ("session_id", "file_key", "epoch")]
    named = text.join(known.where(~F.col("removed")).select(key, "session_id", "file_key", "epoch"), "_key").select("session_id", "file_key", "epoch", "t")
    rows = known.withColumn("t", F.lit(None).cast(named.schema["t"].dataType)).unionByName(named, allowMissingColumns=True)
    d = rows.groupBy("session_id", "file_key", "epoch").agg(F.collect_list("t").alias("texts"), *[F.max(x).alias(x) for x in own])
    joined = F.array_join(F.transform(F.array_sort("texts"), lambda x: F.concat(F.lit("_"), x["s"])), "")
    d = d.select("session_id", "file_key", "epoch", "epoch_seq", "thread_nr", "unique_only", "file_name_4ch", "file_name_orig", "is_new", "base_kind",
                 F.pmod(F.col("base_tog"), F.lit(2)).cast("int").alias("base_tog"), F.concat(F.coalesce("begun", F.lit("")), joined).alias("suffix"),
                 "added", "removed")
    decisions = d.select("session_id", "file_key", *_FIELDS)

    last = events.groupBy("session_id").agg(F.max("seq").alias("last_seq"), F.max_by("value", "seq").alias("last_value"))
    ends = epochs.groupBy("session_id").agg(F.max("epoch").alias("epoch"), F.max("tog").alias("tog"))
    still = d.where(~F.col("removed")).select("session_id", "epoch", F.struct("file_key", *_FIELDS).alias("open"))
    states = last.join(ends, "session_id", "left").join(still, ["session_id", "epoch"], "left")
    if carry is not None:
        states = states.join(carry.select("session_id", "toggles"), "session_id", "left")
    parity = F.coalesce("tog", F.lit(0)) + (F.coalesce("toggles", F.lit(0)) if carry is not None else F.lit(0))
    return decisions, states.select("session_id", "last_seq", "last_value", F.pmod(parity, F.lit(2)).cast("int").alias("toggles"), "open")


def later_decisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The decisions of two consecutive stretches as one: of a file the last epoch's, and of an epoch
    that goes on into the second stretch the second's."""
    rows = before.withColumn("_at", F.lit(0)).unionByName(after.withColumn("_at", F.lit(1)))
    best = F.max_by(F.struct(*_FIELDS), F.struct("epoch_seq", "_at"))
    return rows.groupBy("session_id", "file_key").agg(best.alias("d")).select("session_id", "file_key", "d.*")


def selection_of(decisions: DataFrame) -> DataFrame:
    """The state of each (session, file) from its deciding epoch: session_id, thread_nr, file_key,
    dl_filename (NULL unless selected), is_unique, to_download, removed."""
    n4, orig = F.col("file_name_4ch"), F.col("file_name_orig")
    base = (F.when(F.col("base_kind") == "reset4ch", n4)
            .when(F.col("base_tog") == 1, F.concat_ws("_", n4, orig))
            .otherwise(n4))
    unique = F.coalesce(F.col("is_new"), F.lit(True))
    to_dl0 = ~F.coalesce(F.col("unique_only"), F.lit(False)) | unique
    selected = ~F.col("removed") & (to_dl0 | F.col("added"))
    return decisions.select("session_id", "thread_nr", "file_key",
                            F.when(selected, F.concat(base, F.col("suffix"))).alias("dl_filename"),
                            F.when(F.col("unique_only"), unique).alias("is_unique"),
                            selected.alias("to_download"), "removed")


def fold_curation(events: DataFrame, sessions: DataFrame, files: DataFrame,
                  blocks: int | None = None, cut: bool = True) -> DataFrame:
    """Final per-file state of each session.

    ``events(session_id, seq, value)``, raw or after ``drop_repeats`` (repeats are dropped
    here in the same blockwise pass that numbers the rows; dropping twice changes nothing);
    ``sessions(session_id, thread_nr, unique_only)``;
    ``files(thread_nr, file_key, file_name_4ch, file_name_orig, is_new)`` where ``is_new``
    is the novelty verdict (NULL = unknown, treated as new, as a failed lookup is).

    ``cut``: the numbered log and the table of deciding epochs each feed several branches; they
    are written once to the shared checkpoint folder so that the branches read them instead of
    recomputing their shuffles (and an executor loss does not replay them).

    Returns one row per (session, file) whose URL was copied and found in the thread
    (``selection_of``).
    """
    return selection_of(fold_stretch(events, sessions, files, None, blocks, cut)[0])


def unknown_urls(events: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """J9 audit: copied file URLs whose key is not a file of the session's thread."""
    u = classify(events).where(F.col("kind") == "url").join(sessions.select("session_id", "thread_nr"), "session_id")
    return u.join(files.select("thread_nr", "file_key"), ["thread_nr", "file_key"], "left_anti")


def selection_join(events: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Copied file URLs matched to the thread's files by host-independent key."""
    u = classify(events).where(F.col("kind") == "url").join(sessions.select("session_id", "thread_nr"), "session_id")
    f = files.select("thread_nr", "file_key", "post_nr")
    return u.join(f, ["thread_nr", "file_key"], "left").withColumn("known", F.col("post_nr").isNotNull())


def session_folders(events: DataFrame, default: DataFrame) -> DataFrame:
    """Folder of each session: the last valid ``rename_thread`` payload (names with
    banned characters are refused, as the prompt refuses them), else the default
    ``default(session_id, folder_name)``; plus the report file name
    ``<sanitised folder>_<date of the last event>.txt``."""
    from threadlake.functions import report_date, valid_folder

    c = classify(events)
    ren = (c.where((F.col("kind") == "rename") & F.col("payload").isNotNull() & valid_folder(F.col("payload")))
           .groupBy("session_id").agg(F.max_by(F.trim("payload"), F.col("seq")).alias("renamed")))
    last = c.groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    out = (last.join(default, "session_id", "left").join(ren, "session_id", "left")
           .withColumn("folder_name", F.coalesce(F.col("renamed"), F.col("folder_name"))))
    return out.select("session_id", "folder_name",
                      F.concat(sanitize_name(F.col("folder_name")), F.lit("_"), report_date(F.col("last_ts")),
                               F.lit(".txt")).alias("report_file"))


def selected_files(state: DataFrame) -> DataFrame:
    """rebuild a selection from per-file flags."""
    return state.where(F.col("to_download")).select("session_id", "file_key")


def select_all(files: DataFrame, threads: DataFrame) -> DataFrame:
    """take every file of a thread (only the new ones when ``unique_only``), named
    ``<server>_<original>``. Files are not de-duplicated against each other."""
    f = files.join(threads.select("thread_nr", "unique_only"), "thread_nr")
    keep = ~F.col("unique_only") | F.coalesce(F.col("is_new"), F.lit(True))
    return f.where(keep).select("thread_nr", "file_key",
                                F.concat_ws("_", "file_name_4ch", "file_name_orig").alias("dl_filename"),
                                F.lit(True).alias("to_download"))


def resume_selection(prior: DataFrame, new: DataFrame, keys=("session_id", "file_key")) -> DataFrame:
    """Prior selection state united with a resumed session's; files decided again in
    the new session take the new state."""
    keys = list(keys)
    return prior.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pending_threads(threads: DataFrame, run_state: DataFrame, selection: DataFrame) -> DataFrame:
    """Threads not yet completed that have a non-empty selection; key (board, thread_nr)."""
    done = run_state.where(F.col("done")).select("board", "thread_nr")
    sel = selection.where(F.col("to_download")).select("board", "thread_nr")
    return threads.join(done, ["board", "thread_nr"], "left_anti").join(sel, ["board", "thread_nr"], "left_semi")


def curation_counts(state: DataFrame, events: DataFrame) -> DataFrame:
    """Per session: files selected, files decided, URL copies, removals."""
    c = classify(events).groupBy("session_id").agg(
        F.count_if(F.col("kind") == "url").alias("n_url_events"),
        F.count_if(F.col("kind") == "remove").alias("n_remove_events"))
    s = state.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("to_download")).alias("n_selected"))
    return c.join(s, "session_id", "left").select(
        "session_id", "n_url_events", "n_remove_events",
        F.coalesce(F.col("n_files"), F.lit(0)).cast("bigint").alias("n_files"),
        F.coalesce(F.col("n_selected"), F.lit(0)).cast("bigint").alias("n_selected"))
