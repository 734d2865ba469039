"""Time helpers. Every age is measured against an explicit ``as_of`` instant."""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
# --- fixed values: accepted textual timestamp layouts (tried in order) --------
EPOCH_TEXT_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss",
                      "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
# -----------------------------------------------------------------------------
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def as_of_epoch(as_of) -> int:
    """Accepts epoch seconds, ``datetime`` or an ISO string; naive means UTC."""
    if isinstance(as_of, (int, float)):
        return int(as_of)
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime(as_of.year, as_of.month, as_of.day)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=_dt.timezone.utc)
    return int(as_of.timestamp())


def epoch_from_text(s: Column) -> Column:
    """First format that parses; naive text is UTC (session time zone)."""
    t = F.trim(s)
    parsed = [F.unix_timestamp(F.try_to_timestamp(t, F.lit(f))) for f in EPOCH_TEXT_FORMATS]
    return F.coalesce(*parsed)


def posted_epoch(epoch: Column, iso: Column | None = None) -> Column:
    """Epoch 0/NULL is absent; fall back to an ISO string that carries an offset
    (offset-less ISO text gives an unknown age)."""
    e = F.when(epoch != 0, epoch.cast("long"))
    if iso is None:
        return e
    iso_ok = F.when(iso.rlike(ISO_WITH_OFFSET),
                    F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00"))))
    return F.coalesce(e, iso_ok)


def days_whole(as_of: int, epoch: Column) -> Column:
    """Floored whole days (ranking)."""
    return F.floor((F.lit(as_of) - epoch) / SECONDS_PER_DAY).cast("long")


def days_fractional(as_of: int, epoch: Column) -> Column:
    """Fractional days (filtering)."""
    return (F.lit(as_of) - epoch).cast("double") / SECONDS_PER_DAY


def recency_score(days: Column) -> Column:
    return F.when(days.isNull(), F.lit(0.5)).otherwise(F.exp(-F.greatest(days, F.lit(0)) / 30.0))


def millis_to_utc_text(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
