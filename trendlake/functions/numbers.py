"""Numeric functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WINDOWS


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null, which greatest() and least() alone would not give."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def capped_log(v: Column, cap: float, most: float) -> Column:
    """log1p of v, at most cap, scaled so that cap gives `most`."""
    return F.log1p(clamp(v.cast("double"), 0, cap)) / F.log1p(F.lit(float(cap))) * F.lit(float(most))


def log_signal(v: Column, cap: float) -> Column:
    return capped_log(v, cap, 100)


def linear_signal(v: Column, cap: float) -> Column:
    return clamp(v.cast("double"), 0, cap) / F.lit(float(cap)) * 100.0


def rank_signal(rank: Column, total: Column) -> Column:
    """How near the top a rank, cut to 1..20, is among all."""
    r = F.greatest(F.lit(1), F.least(F.lit(20), rank))
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(1), total - r + 1) / total * 100.0)


def age_hours(at: Column, now: Column) -> Column:
    return F.floor(F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(at)) / 3_600_000_000)


def bucket(at: Column, seconds: int | Column) -> Column:
    return F.floor(F.unix_seconds(at) / seconds)


def traffic_bucket(item_id: Column) -> Column:
    """0..99 from a 64-bit id folded to 32 bits."""
    low = item_id.bitwiseXOR(F.shiftrightunsigned(item_id, 32)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.pmod(F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low), F.lit(100))


def window(code: str) -> tuple:
    """The window of a code; ValueError for others."""
    for w in WINDOWS:
        if w[0] == code.strip().lower():
            return w
    raise ValueError(f"no such window: {code}")


def day_bounds(day: Column) -> tuple[Column, Column]:
    """Start of a UTC day and of the next."""
    return day.cast("timestamp"), F.date_add(day, 1).cast("timestamp")
