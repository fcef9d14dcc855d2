"""Thread report (A8, C12, C14, S8): header, then per fetched file a metadata block,
its message and its indented reply tree.

The report is produced as *rows of text* with a sort key, never as one string per
thread: ``"\\n".join(line ORDER BY key)`` over a thread's rows is the report, and the
text sink writes the rows range-partitioned and sorted, so no thread is gathered into
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import no_message
from threadlake.operators.graph import order_text, reply_tree, tree_lines
from threadlake.session import cut_lineage

# The report's text layout.
HEADER = 'Thread No. %s: "%s", UTC_%s\n\tSaved to: %s\nOP: "%s"\n'
FILE_BLOCK = 'File: "%s.%s", %s, %s, MD5_b64: "%s", Original filename: "%s"\nMessages and Backlinks (indented):'
BLOCK_END = "\n"

# Reports that one task writes: a report is a folder and a file of its own, which take far longer
# to make than its few lines take to write.
REPORTS_PER_RANGE = 100
# Tasks that list the folders.
LISTING_TASKS = 256


def thread_report(threads: DataFrame, fetched: DataFrame, posts: DataFrame, links: DataFrame,
                  files: DataFrame, max_level: int = 3) -> DataFrame:
    """Rows ``(thread_nr, folder_name, key, line)`` of each thread's report.

    ``threads``: thread_nr, subject, utc, op_post_msg, folder_name.
    ``fetched``: successfully fetched files: thread_nr, post_nr, pos, dl_filename, file_ext,
    file_size, file_res, file_md5_b64, file_name_orig (in document order by ``pos``).
    """
    # One row per thread, read by the header and by the file rows: written once.
    t = cut_lineage(threads.select("thread_nr", "folder_name", "subject", "utc", "op_post_msg"))
    header = t.select("thread_nr", "folder_name", F.lit("0").alias("key"),
                      F.format_string(HEADER, "thread_nr", "subject", "utc", "folder_name", "op_post_msg").alias("line"))
    # A file row carries its thread's folder, its sort key and its message; its lines are exploded
    # from it. The tree's walk carries folder and key along, so its lines need no join back.
    fk = F.concat(F.lit("1"), order_text(F.col("pos")))
    f = cut_lineage(fetched.join(t.select("thread_nr", "folder_name"), "thread_nr").withColumn("fk", fk))
    msgs = posts.select("thread_nr", "post_nr", "post_msg")
    own = f.join(msgs, ["thread_nr", "post_nr"], "left")
    meta = F.format_string(FILE_BLOCK, "dl_filename", "file_ext", "file_size", "file_res", "file_md5_b64", "file_name_orig")
    line = lambda part, text: F.struct(F.concat("fk", F.lit(part)).alias("key"), text.alias("line"))
    message = F.when(F.col("post_msg").isNotNull(), line("b", no_message(F.col("post_msg"))))
    lines = F.array_compact(F.array(line("a", meta), message, line("z", F.lit(BLOCK_END))))
    block = own.select("thread_nr", "folder_name", F.explode(lines).alias("l")).select("thread_nr", "folder_name", "l.key", "l.line")
    tree = reply_tree(posts, links, files, f.select("thread_nr", "post_nr", "folder_name", "fk"), max_level, carry=("folder_name", "fk"))
    tl = tree_lines(tree, posts, carry=("folder_name", "fk")).select("thread_nr", "folder_name", F.concat("fk", F.lit("c"), F.col("key")).alias("key"), "line")
    return header.unionByName(block).unionByName(tl)


def ranges_for(threads: DataFrame) -> int:
    """Number of ranges for the reports of ``threads``. Left to Spark it would follow the bytes of
    the lines: about one range a core and of unequal numbers of folders."""
    return max(1, -(-threads.count() // REPORTS_PER_RANGE))


def write_reports(lines: DataFrame, out_dir: str, run_date: str, n_ranges: int | None = None) -> None:
    """Append each thread's report under ``folder=<name>/run_date=<date>/``.

    Rows are range-partitioned on (folder, thread, key) and sorted within partitions, so
    the part files of a folder, read in name order, hold the report lines in order.
    """
    # The sort begins with the writer's own partition columns, under their names: then the writer adds
    # no sort of its own, which would not keep the order of keys.
    df = lines.select(F.col("line").alias("value"), F.col("folder_name").alias("folder"), F.lit(run_date).alias("run_date"), "thread_nr", "key")
    if n_ranges:
        df = df.repartitionByRange(n_ranges, "folder", "thread_nr", "key")
    else:
        df = df.repartitionByRange("folder", "thread_nr", "key")
    (df.sortWithinPartitions("folder", "run_date", "thread_nr", "key").select("value", "folder", "run_date")
     .write.mode("append").partitionBy("folder", "run_date").text(out_dir))


def read_reports(spark: SparkSession, out_dir: str) -> DataFrame:
    """The lines of all reports below ``out_dir`` with their folder and date. Spark lists up to
    10,000 folders by a task each; here a task lists many."""
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(min(int(before), LISTING_TASKS)))
    try:
        return spark.read.schema("value STRING, folder STRING, run_date STRING").text(out_dir)
    finally:
        spark.conf.set(conf, before)
