"""Amounts, rounding and address text, as column expressions.

Amounts are 64-bit integers of 1e-8 units. ``round_half_up`` rounds halves
towards plus infinity; ``spark.round`` rounds them away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATS = 100_000_000
# Address patterns. Fixed values.
ADDRESS_PATTERNS = (
    ("p2pkh", r"^1[1-9A-HJ-NP-Za-km-z]{25,34}$"),
    ("p2sh", r"^3[1-9A-HJ-NP-Za-km-z]{25,34}$"),
    ("bech32", r"^bc1q[02-9ac-hj-np-z]{38,58}$"),
    ("taproot", r"^bc1p[02-9ac-hj-np-z]{58}$"),
    ("testnet", r"^(?:[mn2][1-9A-HJ-NP-Za-km-z]{25,34}|tb1[02-9ac-hj-np-z]{38,58})$"),
)


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def finite(x: Column) -> Column:
    """The number, or 0 for null, NaN and infinities."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(ok, x).otherwise(F.lit(0.0))


def coins_to_sats(x: Column) -> Column:
    return round_half_up(finite(x.cast("double")) * SATS).cast("long")


def format_coins(sats: Column, decimals: int = 8) -> Column:
    """Whole and decimal part; further decimals are cut, not rounded."""
    size = F.abs(sats)
    sign = F.when(sats < 0, F.lit("-")).otherwise(F.lit(""))
    rest = F.substring(F.lpad((size % SATS).cast("string"), 8, "0"), 1, decimals)
    whole = F.floor(size / SATS).cast("long").cast("string")
    return F.concat(sign, whole, F.lit("."), rest) if decimals else F.concat(sign, whole)


def human_coins(sats: Column, unit: str = "BTC") -> Column:
    """Text whose decimals follow the size of the amount."""
    coins = sats / F.lit(float(SATS))
    fixed = lambda d: F.concat(F.format_string(f"%.{d}f", coins), F.lit(f" {unit}"))
    size = F.abs(sats)
    return (
        F.when(sats == 0, F.lit("0"))
        .when(size < 1000, F.concat(sats.cast("string"), F.lit(" sats")))
        .when(size >= 1000 * SATS, fixed(0))
        .when(size >= SATS, fixed(3))
        .when(size >= SATS // 1000, fixed(5))
        .otherwise(fixed(8))
    )


def address_kind(address: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(ADDRESS_PATTERNS):
        out = F.when(address.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def is_real_address(address: Column) -> Column:
    return address_kind(address).isNotNull()


def short_text(text: Column, head: int = 8, tail: int = 6) -> Column:
    n = F.length(text)
    return F.when(n <= head + tail + 2, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, n - tail + 1, F.lit(tail))))


def span_text(seconds: Column) -> Column:
    """A duration in its largest fitting unit."""
    whole = lambda d, u: F.concat(round_half_up(seconds / F.lit(float(d))).cast("string"), F.lit(u))
    tenth = lambda d, u: F.concat(F.format_string("%.1f", seconds / F.lit(float(d))), F.lit(u))
    return (
        F.when(seconds <= 0, F.lit("instant"))
        .when(seconds < 60, whole(1, "s"))
        .when(seconds < 3600, whole(60, "m"))
        .when(seconds < 86400, tenth(3600, "h"))
        .otherwise(tenth(86400, "d"))
    )


def iso_minute(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd HH:mm")


def standardised(columns: list[str], stats: dict[str, tuple[float, float]]) -> list[Column]:
    """(x - mean) / population deviation; a constant column keeps scale 1."""
    return [((F.col(c) - stats[c][0]) / F.lit(stats[c][1] or 1.0)).alias(c) for c in columns]
