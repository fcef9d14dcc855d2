"""URL, name and message predicates (F1-F8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the archive tool's behaviour).
# Thread page URL, matched as a prefix.
THREAD_URL_PATTERN = r"https?://boards\.(4chan|4channel)\.org/[a-z]+/thread/\d+"
# Media file URL, matched as a prefix (\w with Python's Unicode meaning).
FILE_URL_PATTERN = r"(https?:)?//[a-z0-9]+\.(4cdn|4chan)\.org/[a-z]+/(\d+)\.[\w\d]+"
# Host part removed to get a host-independent file key.
FILE_HOST_PREFIX = r"^(https?:)?//[a-z0-9]+\.(4cdn|4chan)\.org/"
# Host files are fetched from.
PREFERRED_SERVER = "i.4cdn.org"
# Words that make a reply a request for the source of a file.
SOURCE_WORDS = ("sauce", "source", "src", "name", "more", "link", "full")
# Characters not allowed in a folder name.
FOLDER_BANNED = ':?*"<>|'
# Media extensions kept by the archive scan (case-sensitive).
VALID_FILE_EXT = ("webm", "gif", "jpg", "png")
# Directory-name substrings pruned from the archive scan. The tool also prunes its own
# program folder; pass that name through ``exclude`` where it matters.
DIR_SUBSTR_EXCLUDE = (".git", "_files", "-Dateien")


def is_thread_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^" + THREAD_URL_PATTERN), F.lit(False))


def is_file_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?U)" + FILE_URL_PATTERN), F.lit(False))


def file_key(url: Column) -> Column:
    """``https://is2.4chan.org/gif/123.webm`` -> ``gif/123.webm``."""
    return F.regexp_replace(url, FILE_HOST_PREFIX, "")


def canonical_url(url: Column, server: str = PREFERRED_SERVER) -> Column:
    """Any file URL (or key) -> ``https://<server>/<key>``."""
    return F.concat(F.lit(f"https://{server}/"), file_key(url))


def is_source_request(msg: Column) -> Column:
    low = F.lower(msg)
    return F.exists(F.array(*[F.lit(w) for w in SOURCE_WORDS]), lambda w: low.contains(w))


def valid_folder(name: Column) -> Column:
    return ~F.trim(name).rlike("[" + FOLDER_BANNED.replace('"', '\\"') + "]")


def allowed_ext(ext: Column, exts: Sequence[str] = VALID_FILE_EXT) -> Column:
    return F.coalesce(ext.isin(*exts), F.lit(False))


def pruned_dir(rel_path: Column, exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE) -> Column:
    """True when a directory below the root (not the file name) contains an excluded substring."""
    segs = F.split(rel_path, "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    subs = F.array(*[F.lit(s) for s in exclude])
    return F.exists(dirs, lambda d: F.exists(subs, lambda s: d.contains(s)))
