"""Decimal dates: YYYYMMDDHHMMSS as a 64-bit integer, UTC, not before 1970. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 19700101000000


def _clamped(d: Column) -> Column:
    return F.when(d < LEAST, F.lit(LEAST)).otherwise(d)  # `greatest` would skip a null


def decimal_date(ts: Column) -> Column:
    return _clamped(F.date_format(ts, "yyyyMMddHHmmss").cast("long"))


def to_timestamp(d: Column) -> Column:
    return F.to_timestamp(F.lpad(d.cast("string"), 14, "0"), "yyyyMMddHHmmss")


def to_epoch(d: Column) -> Column:
    """Seconds since 1970 by the true calendar; dates up to the least are 0."""
    return F.when(d <= LEAST, F.lit(0).cast("long")).otherwise(F.unix_timestamp(to_timestamp(_clamped(d))))


def show(d: Column, zone: str | None = None) -> Column:
    """YYYY-MM-DD HH:MM:SS, 19 blanks below the least date."""
    ts = to_timestamp(_clamped(d))
    return F.when(d < LEAST, F.lit(" " * 19)).otherwise(F.date_format(F.from_utc_timestamp(ts, zone) if zone else ts, "yyyy-MM-dd HH:mm:ss"))


def zero_pad(n: Column, digits: int) -> Column:
    """The low digits of n, padded with zeros."""
    return F.lpad(F.pmod(n.cast("long"), F.lit(10**digits)).cast("string"), digits, "0")


def after(now: Column, initial: Column) -> Column:
    """Now if it is later than `initial`, else one second after it."""
    return F.when(now > initial, now).otherwise(initial + F.expr("interval 1 second"))
