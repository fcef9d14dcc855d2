"""Running values over ordered rows per key, safe for a key holding a large share of rows.

A window ``PARTITION BY key ORDER BY seq`` sorts a whole key in one task. Here rows are
range-partitioned on ``(key, seq)``: a block is the part of a key that lies in one range
partition, so a block never holds more rows than a partition does, whatever the numbers
in ``seq`` look like (dense, microseconds, generated ids with gaps), and a key has at
most as many blocks as there are partitions. Each block is summed with a partial
aggregate, the block totals get an exclusive prefix per key (one row per block, so even
a hot key is small there), and the offset is joined back on ``(key, block)``; the
in-block running sum reuses the join's ``(key, block)`` partitioning.

Range bounds come from a sample, so the rows are written once with their block number
(``session.cut_lineage``): every branch, and every retry after a lost executor, reads the
same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import cut_lineage

BLOCK = "_blk"


def with_blocks(df: DataFrame, keys: Sequence[str], seq: str, blocks: int | None = None) -> DataFrame:
    """``df`` with the column ``_blk``, ascending in ``seq`` within a key. ``blocks``: how many
    range partitions (default: ``spark.sql.shuffle.partitions``)."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, seq).withColumn(BLOCK, F.spark_partition_id()))


def prefix_sums(df: DataFrame, keys: Sequence[str], seq: str, values: dict[str, Column],
                blocks: int | None = None) -> DataFrame:
    """Add inclusive running sums ``out = sum(expr) over rows with seq' <= seq`` per ``keys``.

    ``seq`` is an integer column, unique within a key. ``values`` maps output names to
    numeric expressions over ``df``.
    """
    keys = list(keys)
    blk = BLOCK
    base = with_blocks(df, keys, seq, blocks).select("*", *[expr.cast("bigint").alias(f"_v_{name}") for name, expr in values.items()])
    tot = base.groupBy(*keys, blk).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    wb = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, blk, *[F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)).alias(f"_o_{n}") for n in values])
    wi = Window.partitionBy(*keys, blk).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(off, [*keys, blk])
    keep = [c for c in df.columns]
    return out.select(*keep, *[(F.sum(f"_v_{n}").over(wi) + F.col(f"_o_{n}")).cast("bigint").alias(n) for n in values])


def previous_value(df: DataFrame, keys: Sequence[str], seq: str, col: str, out: str,
                   blocks: int | None = None) -> DataFrame:
    """``lag(col)`` per key ordered by ``seq``, computed blockwise (see module doc)."""
    keys = list(keys)
    blk = BLOCK
    base = with_blocks(df, keys, seq, blocks)
    last = base.groupBy(*keys, blk).agg(F.max_by(F.col(col), F.col(seq)).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(blk)
    prev_blk = last.select(*keys, blk, F.lag("_last").over(wb).alias("_prev_block_last"),
                           F.lag(blk).over(wb).isNotNull().alias("_has_prev"))
    wi = Window.partitionBy(*keys, blk).orderBy(seq)
    first_in_block = F.row_number().over(wi) == 1
    joined = base.join(prev_blk, [*keys, blk])
    res = (joined.withColumn(out, F.when(first_in_block, F.col("_prev_block_last")).otherwise(F.lag(col).over(wi)))
           .withColumn(f"{out}_exists", F.when(first_in_block, F.col("_has_prev")).otherwise(F.lit(True))))
    return res.drop(blk, "_prev_block_last", "_has_prev")


def dedup_prefix_sums(df: DataFrame, keys: Sequence[str], seq: str, col: str, values: dict[str, Column],
                      blocks: int | None = None) -> DataFrame:
    """Drop rows whose ``col`` equals the key's previous row, and add inclusive running sums
    over the rows kept, in one blockwise pass.

    Inside a block, ``lag`` decides every row but the first, and the running sums cover
    those rows. The block table (one row per block) carries the block's last value, its
    first row's value and flags, and the kept totals; a window over it decides each first
    row against the previous block's last value and gives each block its offset, which
    is joined back on ``(key, block)``.
    """
    keys = list(keys)
    blk = BLOCK
    names = list(values)
    base = with_blocks(df, keys, seq, blocks)
    wi = Window.partitionBy(*keys, blk).orderBy(seq)
    wir = wi.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(wi) == 1
    keep_in = ~first & ~F.col(col).eqNullSafe(F.lag(col).over(wi))
    a = base.select("*", first.alias("_first"), keep_in.alias("_keep_in"),
                    *[expr.cast("bigint").alias(f"_x_{n}") for n, expr in values.items()])
    a = a.select("*", *[F.sum(F.when(F.col("_keep_in"), F.col(f"_x_{n}")).otherwise(F.lit(0))).over(wir)
                        .alias(f"_r_{n}") for n in names])
    totals = a.groupBy(*keys, blk).agg(
        F.max_by(F.col(col), F.col(seq)).alias("_last"),
        F.min_by(F.struct(F.col(col).alias("v"), *[F.col(f"_x_{n}").alias(n) for n in names]), F.col(seq))
        .alias("_head"),
        *[F.sum(F.when(F.col("_keep_in"), F.col(f"_x_{n}")).otherwise(F.lit(0))).alias(f"_t_{n}") for n in names])
    wb = Window.partitionBy(*keys).orderBy(blk)
    head_keep = ~F.col("_head.v").eqNullSafe(F.lag("_last").over(wb))
    b1 = totals.select(*keys, blk, head_keep.alias("_head_keep"),
                       *[F.col(f"_head.{n}").alias(f"_h_{n}") for n in names],
                       *[F.col(f"_t_{n}") for n in names])
    wbx = wb.rowsBetween(Window.unboundedPreceding, -1)
    b2 = b1.select(*keys, blk, "_head_keep", *[f"_h_{n}" for n in names],
                   *[F.coalesce(F.sum(F.col(f"_t_{n}") + F.when(F.col("_head_keep"), F.col(f"_h_{n}")).otherwise(0))
                                .over(wbx), F.lit(0)).alias(f"_o_{n}") for n in names])
    j = a.join(b2, [*keys, blk])
    keep = F.when(F.col("_first"), F.col("_head_keep")).otherwise(F.col("_keep_in"))
    out = j.where(keep).select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.when(F.col("_head_keep"), F.col(f"_h_{n}")).otherwise(F.lit(0)) + F.col(f"_r_{n}"))
          .cast("bigint").alias(n) for n in names])
    return out
