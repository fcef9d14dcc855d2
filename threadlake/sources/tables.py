"""Parquet tables (S1: the crawl table replaces fetching pages one by one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES_DDL = "page_id BIGINT, url STRING, html STRING"


_TABLES: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``; the DataFrame (not data) is reused per session and path,
    so repeated references share one analysed scan instead of re-listing and re-reading
    footers."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawled pages ``(page_id, url, html)``.

    ``fmt="parquet"``: a crawl table. ``fmt="text"``: a folder of saved pages, one file
    per page (``wholetext``); the file path becomes ``url`` and ``page_id`` a hash of it.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html")
    from pyspark.sql import functions as F

    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("page_id"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )
