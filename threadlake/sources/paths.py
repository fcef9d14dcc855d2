"""Paths of files below a root, as the user knows them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def root_path(spark: SparkSession, root: str) -> str:
    """The absolute path of ``root`` without scheme and authority, whichever way it is given
    (relative, plain, with a scheme)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath()


def root_uri(spark: SparkSession, root: str) -> str:
    """``root`` as an absolute URI, for file access inside tasks."""
    from urllib.parse import quote

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{quote(uri.getPath().rstrip('/') or '/')}"


def relative_to(spark: SparkSession, root: str) -> Column:
    """The path of a row's file below ``root``. ``_metadata.file_path`` is a URI: its escapes
    are undone ("+" stands for itself there)."""
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(path, F.lit(len(root_path(spark, root).rstrip("/")) + 2), F.length(path))
