"""Time-zone-independent time expressions.

Timestamps in this library are TIMESTAMP_NTZ (wall clock, no zone).  Epoch
microseconds and literals are formed without the session time zone, so results
do not change when a caller's session is not in UTC (or crosses a DST change).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock timestamp."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)


def ntz_literal(value: datetime | date) -> Column:
    """A TIMESTAMP_NTZ literal built from text (no local-zone conversion)."""
    if not isinstance(value, datetime):
        value = datetime.combine(value, datetime.min.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
