"""Dates: parsing of feed stamps and period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_time(text: Column) -> Column:
    """Timestamp of an RFC 822 or ISO 8601 stamp; null if it is neither."""
    rfc = F.regexp_extract(text, r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})$", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(rfc, F.lit("")), F.lit("d MMM yyyy HH:mm:ss xx")), text.try_cast("timestamp"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def period(ts: Column, unit: str) -> Column:
    """Label of the day, week (Monday first, days before the first Monday are week 00), month or year; other units: month."""
    if unit == "week":
        monday0 = (F.dayofweek(ts) + 5) % 7
        week = F.floor((F.dayofyear(ts) + 6 - monday0) / 7)
        return F.concat_ws("-", F.date_format(ts, "yyyy"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, {"day": "yyyy-MM-dd", "year": "yyyy"}.get(unit, "yyyy-MM"))
