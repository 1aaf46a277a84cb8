"""Dates: parsing platform formats, formatting, and calendar presets.

``now`` and ``today`` are always arguments, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitrep import constants as K

PRESETS = ["this-week", "last-week", "this-month", "last-30-days", "this-year"]


def parse_post_date(c: Column, now: Column) -> Column:
    """'Fri Apr 11 13:57:55 +0000 2025', then ISO 8601 with a whole date, else ``now``."""
    platform = F.try_to_timestamp(F.substr(c, F.lit(5)), F.lit("MMM d HH:mm:ss Z yyyy"))
    iso = F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(c))
    return F.coalesce(platform, iso, now)


def epoch_to_timestamp(c: Column) -> Column:
    """Epoch seconds in any textual or numeric form; anything else is null."""
    return F.timestamp_seconds(c.cast("string").try_cast("bigint"))


def iso_string(c: Column) -> Column:
    """ISO 8601; fractions of a second are written, all six digits, where there are any."""
    at = c.cast("timestamp")
    return F.when(
        F.pmod(F.unix_micros(at), F.lit(1_000_000)) == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def epoch_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def month_number(name: str | None) -> int | None:
    """Month of a phrase such as 'November 2025'; unknown names give no filter."""
    if not name:
        return None
    first = name.split(" ")[0].lower()
    return K.MONTHS.index(first) + 1 if first in K.MONTHS else None


def preset_range(preset: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a preset, relative to ``today``."""
    today = today.cast("date")
    monday = F.trunc(today, "week")
    if preset == "this-week":
        return monday, today
    if preset == "last-week":
        return F.date_sub(monday, 7), F.date_sub(monday, 1)
    if preset == "this-month":
        return F.trunc(today, "month"), today
    if preset == "last-30-days":
        return F.date_sub(today, 30), today
    return F.trunc(today, "year"), today
