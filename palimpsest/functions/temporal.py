"""Recency and timestamps as column expressions; the present moment is always an argument."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = re.compile(r"\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?")


def moment(text: str) -> datetime | None:
    """An ISO 8601 text as a naive moment, any offset dropped rather than converted; None if it is none."""
    if not _ISO.fullmatch(text):
        return None
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None


def at(when: datetime | str) -> Column:
    return F.lit(str(when)).cast("timestamp_ntz")


def recency(ts: Column, now: datetime | str) -> Column:
    """1 / (1 + age in days), ages below 0 as 0, and 0 where the time is missing."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = (micros(at(now)) - micros(ts)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), days)), F.lit(0.0))
