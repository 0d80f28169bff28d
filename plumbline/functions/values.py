"""Strict parsing of hashes, dates and decimals, and the bits and checksums that queries and routing use."""

from __future__ import annotations

import math
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

_HEX = re.compile(r"[0-9a-fA-F]+")
BUCKETS = 4096


def hash_bits(text: Column) -> Column:
    """The 64 bits of a hex string (0x is optional) as a signed BIGINT; null where it is not one."""
    digits = F.regexp_replace(F.trim(text), "^0[xX]", "")
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    full = F.lpad(short, 16, "0")
    half = lambda at: F.conv(F.substring(full, at, 8), 16, 10).cast("long")
    return F.when(digits.rlike("^[0-9a-fA-F]+$") & (F.length(short) <= 16), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hash_literal(text: str) -> int:
    """The same for a value of a request."""
    t = text.strip()
    t = t[2:] if t[:2].lower() == "0x" else t
    if not _HEX.fullmatch(t) or int(t, 16) >= 1 << 64:
        raise QueryError("type_mismatch", f"not a 64-bit hex string: {text!r}")
    v = int(t, 16)
    return v - (1 << 64) if v >= 1 << 63 else v


def hamming(bits: Column, query: int) -> Column:
    return F.bit_count(bits.bitwiseXOR(F.lit(query).cast("long")))


def strict_date(text: Column) -> Column:
    """DATE of a `YYYY-MM-DD` string of the years 0001 to 9999; null for anything else."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000"), F.try_to_date(text, "yyyy-MM-dd"))


def strict_decimal(text: Column, precision: int, scale: int) -> Column:
    """DECIMAL of a plain decimal string that fits without rounding; null for anything else."""
    whole = F.length(F.regexp_replace(F.regexp_extract(text, r"^-?(\d+)", 1), "^0+", ""))
    parts = F.length(F.regexp_extract(text, r"\.(\d+)$", 1))
    plain = text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$")
    return F.when(plain & (whole <= precision - scale) & (parts <= scale), text.cast(f"decimal({precision},{scale})"))


def decimal_literal(value, precision: int, scale: int) -> Decimal:
    try:
        d = Decimal(str(value))
    except InvalidOperation:
        raise QueryError("invalid_number", f"not a decimal: {value!r}") from None
    if not d.is_finite() or -d.as_tuple().exponent > scale or len(d.as_tuple().digits) + d.as_tuple().exponent > precision - scale:
        raise QueryError("invalid_number", f"{value!r} does not fit decimal({precision},{scale})")
    return d


def number_literal(value, bound: bool = False) -> float:
    """A finite number; bounds of ranges may be infinite."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise QueryError("type_mismatch", f"not a number: {value!r}")
    if math.isnan(value) or (math.isinf(value) and not bound):
        raise QueryError("invalid_number", f"not a finite number: {value!r}")
    return float(value)


def route(collection: str, key: Column, buckets: int = BUCKETS) -> Column:
    """The virtual bucket of a key: crc32 over collection, a zero byte and the key."""
    return F.pmod(F.crc32(F.concat(F.encode(F.lit(collection), "UTF-8"), F.unhex(F.lit("00")), F.encode(key, "UTF-8"))), F.lit(buckets)).cast("int")
