"""Unsigned 64-bit decimal text and the signed 64-bit patterns that hold it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^63 and 2^64.
HALF, WHOLE = "9223372036854775808", "18446744073709551616"


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(20,0)")


def format_u64(bits: Column) -> Column:
    """Decimal text of the pattern read as unsigned."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + _decimal(WHOLE)).otherwise(wide).cast("decimal(20,0)").cast("string")


def parse_u64(text: Column, strict: bool = True) -> Column:
    """Pattern of an unsigned decimal below 2^64, with an optional plus sign. Other texts raise an error,
    or give null where ``strict`` is false."""
    valid = text.rlike(r"^\+?[0-9]+$") & (F.length(F.regexp_replace(text, r"^\+?0*", "")) <= 20)
    value = F.when(valid, text.try_cast("decimal(20,0)"))
    value = F.when(value < _decimal(WHOLE), value)
    bits = F.when(value >= _decimal(HALF), value - _decimal(WHOLE)).otherwise(value).cast("long")
    if strict:
        return F.when(text.isNull() | bits.isNotNull(), bits).otherwise(F.raise_error(F.concat(F.lit("not an unsigned 64-bit number: "), text)).cast("long"))
    return bits
