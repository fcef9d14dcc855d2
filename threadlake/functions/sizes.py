"""Size buckets.

The archive keys files by size in MB rounded to two decimals, the way Python's
``round(x, 2)`` rounds: half to even on the exact value. Sizes are dyadic fractions
(bytes / 2^20, KB / 2^10), so the rounding is done exactly in integers instead of on
doubles, and the result is a DECIMAL(12,2) that is safe to join on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Bytes per MB and KB, and the number of decimals of a size bucket.
BYTES_PER_MB = 1024 * 1024
KB_PER_MB = 1024
SIZE_DECIMALS = 2

SIZE_TYPE = DecimalType(12, 2)


def half_even_div(num: Column, den: int) -> Column:
    """round-half-even(num / den) for non-negative BIGINT ``num`` and positive ``den``, exact."""
    r = F.pmod(num, F.lit(den))
    q = ((num - r) / F.lit(den)).cast("bigint")
    up = (r * 2 > den) | ((r * 2 == den) & (F.pmod(q, F.lit(2)) == 1))
    return q + F.when(up, 1).otherwise(0)


def _cents_to_mb(cents: Column) -> Column:
    return (cents / F.lit(100.0)).cast(SIZE_TYPE)


def size_bucket(size_bytes: Column) -> Column:
    """Bytes -> MB bucket, ``round(bytes / 2**20, 2)`` as DECIMAL(12,2)."""
    return _cents_to_mb(half_even_div(size_bytes.cast("bigint") * 100, BYTES_PER_MB))


def size_text_mb(size_text: Column) -> Column:
    """Site size text -> MB bucket.

    ``"<x> KB"`` -> round(x / 1024, 2), with any number of decimals: those beyond thousandths only
    decide what would else be a tie. ``"<x> MB"`` -> x; with decimals that are not zero beyond the
    second it equals no bucket: NULL. Any other unit (``"500 B"``) or shape -> NULL. Texts that
    have no bucket are rejects (``size_text_reject``).
    """
    shape = r"^([0-9]{1,10})(?:\.([0-9]+))? (KB|MB)$"
    whole, decimals, unit = (F.regexp_extract(size_text, shape, i) for i in (1, 2, 3))
    thousandths = F.rpad(F.substring(decimals, 1, 3), 3, "0")
    rest = F.regexp_replace(F.substring(decimals, F.lit(4), F.length(decimals)), "0+$", "")
    num = (whole.try_cast("bigint") * 1000 + thousandths.try_cast("bigint")) * 100
    den = KB_PER_MB * 1000
    tie_up = (rest != "") & (F.pmod(num, F.lit(den)) * 2 == den)
    kb = _cents_to_mb(F.when(tie_up, ((num - F.pmod(num, F.lit(den))) / F.lit(den)).cast("bigint") + 1).otherwise(half_even_div(num, den)))
    mb = F.when(F.rtrim(decimals, F.lit("0")).rlike("^[0-9]{0,2}$"), F.concat(whole, F.lit("."), F.substring(thousandths, 1, 2)).try_cast(SIZE_TYPE))
    return F.when(unit == "KB", kb).when(unit == "MB", mb).otherwise(F.lit(None).cast(SIZE_TYPE))


def size_text_reject(size_text: Column) -> Column:
    """Why a size text has no bucket: ``no_size``, ``unknown_unit``, ``odd_size``; NULL if it has one."""
    return (F.when(size_text_mb(size_text).isNotNull(), F.lit(None).cast("string"))
            .when(size_text.isNull() | (F.trim(size_text) == ""), F.lit("no_size"))
            .when(size_text.rlike(r"^[0-9]+(\.[0-9]+)? [A-Za-z]+$") & ~size_text.rlike(" (KB|MB)$"), F.lit("unknown_unit"))
            .otherwise(F.lit("odd_size")))


def format_size_text(size_bytes: Column) -> Column:
    """Bytes -> the site's display text: whole KB under 1 MB, else MB with two decimals."""
    b = size_bytes.cast("bigint")
    kb = F.concat((F.floor(b / 1024)).cast("bigint").cast("string"), F.lit(" KB"))
    cents = (F.floor(b * 100 / BYTES_PER_MB)).cast("bigint")
    mb = F.concat((F.floor(cents / 100)).cast("bigint").cast("string"), F.lit("."),
                  F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"), F.lit(" MB"))
    return F.when(b < BYTES_PER_MB, kb).otherwise(mb)
