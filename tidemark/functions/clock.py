"""Instants: strict UTC text, broker epochs, weekdays and half-open windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text of an instant that names UTC; anything without an offset, or with another one, is refused.
UTC_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|\+00:00)$"


def utc_instant(text: Column) -> Column:
    """A timestamp of UTC text, null for naive text, other offsets and what is no date."""
    return F.when(text.rlike(UTC_TEXT), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def epoch_us(seconds: Column, millis: Column | None = None, offset_s: Column | int = 0) -> Column:
    """Microseconds since the epoch of a broker's clock that is ``offset_s`` ahead of UTC.

    Milliseconds win over seconds; zero and values that aren't finite count as missing.
    """
    finite = lambda c: F.when((c != 0) & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 1e15), c)
    whole = F.round(finite(seconds).cast("double") * 1_000_000).cast("bigint")
    if millis is not None:
        whole = F.coalesce(F.round(finite(millis).cast("double") * 1000).cast("bigint"), whole)
    return whole - (offset_s if isinstance(offset_s, Column) else F.lit(offset_s)).cast("bigint") * 1_000_000


def next_weekday(day: Column) -> Column:
    """The day itself, or the Monday after a Saturday or Sunday."""
    number = F.weekday(day)  # Monday is 0
    return F.when(number >= 5, F.date_add(day, 7 - number)).otherwise(day)


def in_window(us: Column, start_us: int, end_us: int, now_us: int) -> Column:
    """Whether an instant is in [start, end + one day); undated rows only if the window reaches now."""
    day = 86_400_000_000
    return F.when(us.isNull(), F.lit(end_us >= now_us - day)).otherwise((us >= start_us) & (us < end_us + day))
