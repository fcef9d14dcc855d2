"""Index snapshots (S6, S7) and run state.

The archive tool pickles a nested dict; here the flat index is Parquet partitioned by
extension (partition pruning for lookups of one type), or JSON lines with sorted keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions.sizes import SIZE_TYPE
from threadlake.operators.index import INDEX_KEYS
from threadlake.session import cut_lineage
from threadlake.sources.versions import Version, VersionedTable

INDEX_DDL = "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING"
RUN_STATE_DDL = "board STRING, thread_nr STRING, stage STRING, done BOOLEAN"


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by ext; rows sorted by (size_mb, md5_b64) inside each file, so
    row-group min/max statistics let a lookup of one digest skip most of the data."""
    (index.select(*INDEX_KEYS, "path").sortWithinPartitions("ext", "size_mb", "md5_b64")
     .write.mode(mode).partitionBy("ext").parquet(path))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(path).select(*INDEX_KEYS, "path")


def index_json_lines(index: DataFrame) -> DataFrame:
    """One JSON object per stored file, keys sorted; the size is a JSON number."""
    return index.select(F.to_json(F.struct(
        "ext", "md5_b64", "path", F.col("size_mb").cast("double").alias("size_mb"))).alias("value"))


def save_index_json(index: DataFrame, path: str) -> None:
    """Key-sorted JSON lines, rows in key order (range-partitioned sort, so part files
    read in name order are sorted)."""
    ordered = index.orderBy(*INDEX_KEYS, "path")
    index_json_lines(ordered).write.mode("overwrite").text(path)


def load_index_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    j = F.from_json("value", "ext STRING, md5_b64 STRING, path STRING, size_mb DOUBLE")
    return raw.select(j.alias("r")).select("r.ext", F.col("r.size_mb").cast(SIZE_TYPE).alias("size_mb"),
                                           "r.md5_b64", "r.path")


def nested_lines(index: DataFrame) -> DataFrame:
    """S7 in the archive's own layout: ``{ext: {size: {digest: [paths]}}}`` with sorted keys, indented
    by four, as rows ``(ext, size_mb, md5_b64, path, i, line)`` in the order of these columns. Which
    braces open and close at a path is told by the smallest and largest keys of each group
    (partial aggregates, joined back), so no group is gathered."""
    keys = list(INDEX_KEYS)
    rows = index.select(*keys, "path").distinct()
    digest = rows.groupBy(*keys).agg(F.min("path").alias("p0"), F.max("path").alias("p1"))
    size = digest.groupBy("ext", "size_mb").agg(F.min("md5_b64").alias("m0"), F.max("md5_b64").alias("m1"))
    ext = cut_lineage(size.groupBy("ext").agg(F.min("size_mb").alias("s0"), F.max("size_mb").alias("s1")))
    e0, e1 = ext.agg(F.min("ext"), F.max("ext")).first()
    ends = digest.join(size, ["ext", "size_mb"]).join(ext, "ext").withColumn("_key", F.struct(*keys)).drop(*keys)
    x = rows.withColumn("_key", F.struct(*keys)).join(ends, "_key")
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    number = F.concat(F.lit('"'), F.regexp_replace(F.col("size_mb").cast("string"), r"(\.\d)0$", "$1"), F.lit('"'))
    p0, m0, s0 = F.col("path") == F.col("p0"), F.col("md5_b64") == F.col("m0"), F.col("size_mb") == F.col("s0")
    p1, m1, s1 = F.col("path") == F.col("p1"), F.col("md5_b64") == F.col("m1"), F.col("size_mb") == F.col("s1")
    first, last = (F.col("ext") == F.lit(v) for v in (e0, e1))
    comma = lambda end: F.when(end, F.lit("")).otherwise(F.lit(","))
    put = lambda depth, *parts: F.concat(F.lit(" " * 4 * depth), *parts)
    lines = F.array_compact(F.array(
        F.when(p0 & m0 & s0 & first, F.lit("{")),
        F.when(p0 & m0 & s0, put(1, text("ext"), F.lit(": {"))),
        F.when(p0 & m0, put(2, number, F.lit(": {"))),
        F.when(p0, put(3, text("md5_b64"), F.lit(": ["))),
        put(4, text("path"), comma(p1)),
        F.when(p1, put(3, F.lit("]"), comma(m1))),
        F.when(p1 & m1, put(2, F.lit("}"), comma(s1))),
        F.when(p1 & m1 & s1, put(1, F.lit("}"), comma(last))),
        F.when(p1 & m1 & s1 & last, F.lit("}"))))
    return x.select(*keys, "path", F.posexplode(lines).alias("i", "line"))


def save_index_nested(index: DataFrame, path: str) -> None:
    """The nested layout as text; part files in order of name make up one JSON object."""
    (nested_lines(index).orderBy(*INDEX_KEYS, "path", "i").select(F.col("line").alias("value"))
     .write.mode("overwrite").text(path))


def load_index_nested(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an archive's nested index (indented by four, as the archive writes it), however
    large the object is: the text is read by lines, and a line's depth is its indentation. A path
    belongs to the last extension, size and digest opened before it; these are carried on within
    each file split, and from split to split by a table of one row per split. A size that holds a
    set of digests instead (``_set_object``) gives rows without a path."""
    quoted = r'("(?:[^"\\]|\\.)*")'
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    plain = lambda group, pattern: F.from_json(F.concat(F.lit("["), F.regexp_extract("value", pattern, group), F.lit("]")), "array<string>")[0]
    opens, item = rf"^( +){quoted}: [\[{{]$", rf"^ {{16}}{quoted},?$"
    depth = F.length(F.regexp_extract("value", opens, 1)) / 4
    lines = cut_lineage(lines.select(
        "file", "block", "id", *[F.when(depth == d, plain(2, opens)).alias(name) for d, name in ((1, "ext"), (2, "size"), (3, "md5"))],
        F.when(F.col("value").rlike(item), plain(1, item)).alias("item")))
    names = ["ext", "size", "md5"]
    split = ["file", "block"]
    ends = lines.groupBy(*split).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in names])
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # over splits
    ends = ends.select(*split, *[F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in names])
    within = Window.partitionBy(*split).orderBy("id")
    x = lines.select(*split, "item", *[F.last(c, ignorenulls=True).over(within).alias(c) for c in names]).where("item is not null")
    x = x.join(ends, split).select("item", *[F.coalesce(c, f"_{c}").alias(c) for c in names])
    is_set = F.col("md5") == "_set_object"
    return x.select("ext", F.col("size").try_cast(SIZE_TYPE).alias("size_mb"), F.when(is_set, F.col("item")).otherwise(F.col("md5")).alias("md5_b64"),
                    F.when(~is_set, F.col("item")).alias("path"))


def run_state_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, RUN_STATE_DDL)


def save_run_state(state: DataFrame, path: str, since: Version | None = None) -> Version:
    """The run state is a small table rewritten after each thread. The new state is published
    as the table's next version; the one before stays whole until then, and a writer that stops in
    between leaves it so. ``since``: refuse (``StaleVersion``) if another run has saved its state
    after that version was loaded."""
    rows = state.select("board", "thread_nr", "stage", "done")
    return run_state_table(state.sparkSession, path).replace(rows, since)


def load_run_state(spark: SparkSession, path: str) -> DataFrame:
    return run_state_table(spark, path).read()


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-column text sink (``overwrite`` or ``append``)."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode(mode).text(path)


def save_index_table(index: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """The index as a catalog table bucketed and sorted on its key ``(ext, size_mb,
    md5_b64)``: grouping it per key and joining candidates to it then shuffle only the
    candidate side (the index side is already co-located by bucket). ``path`` makes it
    an external table at that location."""
    w = (index.select(*INDEX_KEYS, "path").write.mode("overwrite")
         .bucketBy(buckets, *INDEX_KEYS).sortBy(*INDEX_KEYS))
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
