"""Timestamp arithmetic that is exact and time-zone independent.

Inputs are TIMESTAMP_NTZ.  ``unix_timestamp`` drops sub-second digits and
``timestampdiff(DAY)`` truncates toward zero, so differences are taken in
microseconds with ``timestamp_diff`` and floored explicitly (semantics S4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SECONDS_PER_DAY = 86_400


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (no zone shift)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


def seconds_between(end, start) -> Column:
    """``end - start`` in (fractional) seconds, DOUBLE."""
    return F.timestamp_diff("MICROSECOND", _c(start).cast("timestamp_ntz"),
                            _c(end).cast("timestamp_ntz")) / F.lit(float(MICROS_PER_SECOND))


def hours_between(end, start) -> Column:
    return seconds_between(end, start) / F.lit(3600.0)


def minutes_between(end, start) -> Column:
    return seconds_between(end, start) / F.lit(60.0)


def days_between(end, start) -> Column:
    """Fractional days."""
    return seconds_between(end, start) / F.lit(float(SECONDS_PER_DAY))


def floor_days_between(end, start) -> Column:
    """Whole days, floored (a negative 1.5 days is -2, as a timedelta's days)."""
    return F.floor(days_between(end, start)).cast("bigint")


def shift(ts, days: float = 0.0, hours: float = 0.0, seconds: float = 0.0) -> Column:
    """``ts + duration``; the duration is converted to whole microseconds."""
    micros = int(round((days * SECONDS_PER_DAY + hours * 3600 + seconds) * MICROS_PER_SECOND))
    return F.timestamp_add("MICROSECOND", F.lit(micros), _c(ts).cast("timestamp_ntz"))


def shift_by(ts, seconds_col) -> Column:
    """``ts + seconds_col`` seconds where the amount is a column."""
    return F.timestamp_add("MICROSECOND",
                           F.round(_c(seconds_col) * MICROS_PER_SECOND).cast("bigint"),
                           _c(ts).cast("timestamp_ntz"))


def ceil_to_hour(ts) -> Column:
    """Round a timestamp up to the hour."""
    t = _c(ts).cast("timestamp_ntz")
    trunc = F.date_trunc("hour", t).cast("timestamp_ntz")
    return F.when(trunc == t, t).otherwise(F.timestamp_add("HOUR", F.lit(1), trunc))


def hour_grid(start, end, before_hours: int = 24) -> Column:
    """Array of hourly timestamps from ``ceil_hour(start) - before_hours`` to ``end``."""
    first = F.timestamp_add("HOUR", F.lit(-before_hours), ceil_to_hour(start))
    return F.sequence(first, _c(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))
