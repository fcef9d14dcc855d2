"""MD5 digests in their three spellings: raw bytes, lower-case hex, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def b64_to_hex(col: Column) -> Column:
    """Base64 digest text -> lower-case hex (pad bits are ignored, as a base64 decoder does).
    Text that is not base64 gives NULL instead of failing the job."""
    return F.lower(F.hex(F.try_to_binary(col, F.lit("base64"))))


def hex_to_b64(col: Column) -> Column:
    """Hex digest -> base64 text, without a trailing newline (NULL for non-hex text)."""
    return F.base64(F.try_to_binary(col, F.lit("hex")))


def md5_b64(content: Column) -> Column:
    """Base64 MD5 of a binary/string column (the form the site publishes)."""
    return hex_to_b64(F.md5(content))


def digest_equal(declared_b64: Column, actual_hex: Column) -> Column:
    """Declared base64 digest vs actual hex digest, compared as bytes; NULL-safe."""
    return F.try_to_binary(declared_b64, F.lit("base64")).eqNullSafe(F.try_to_binary(actual_hex, F.lit("hex")))
