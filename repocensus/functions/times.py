"""History timestamps.

History tables hold UTC wall-clock TIMESTAMP_NTZ plus the commit's own offset, so nothing
here depends on the session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CUTOFF = -1
# Fixed value: how the zero time prints.
ZERO_TIME = "0001-01-01T00:00:00Z"

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?(Z|[+-]\d{2}:\d{2})?")
_AGO = re.compile(r"(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago", re.I)


def cutoff_seconds(text: Column | str | None) -> Column:
    """Epoch seconds of a cutoff: '' or NULL means none (-1).

    ISO dates (UTC unless an offset is given), ``N <units> ago``, ``now``, ``today`` and
    ``yesterday`` are understood; anything else is rejected.
    """
    if isinstance(text, Column):
        iso = F.try_to_timestamp(text)
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_CUTOFF)).otherwise(
            F.unix_seconds(iso)
        )
    text = (text or "").strip()
    if not text:
        return F.lit(NO_CUTOFF).cast("bigint")
    if _ISO.fullmatch(text):
        zoned = text if re.search(r"(Z|[+-]\d{2}:\d{2})$", text[10:]) else text + "Z" * (len(text) > 10)
        if len(text) == 10:
            zoned = text + " 00:00:00Z"
        return F.unix_seconds(F.to_timestamp(F.lit(zoned)))
    ago = _AGO.fullmatch(text)
    if ago:
        amount, unit = int(ago.group(1)), ago.group(2).upper()
        return F.unix_seconds(F.expr(f"timestampadd({unit}, -{amount}, current_timestamp())"))
    if text.lower() == "now":
        return F.unix_seconds(F.current_timestamp())
    if text.lower() in ("today", "yesterday"):
        days = 0 if text.lower() == "today" else 1
        return F.unix_seconds(
            F.date_trunc("DAY", F.expr(f"timestampadd(DAY, -{days}, current_timestamp())"))
        )
    raise ValueError(f"could not parse date string '{text}'")


def epoch_seconds(ntz: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), F.date_trunc("SECOND", ntz))


def own_clock(ntz: Column, offset_minutes: Column) -> Column:
    """The committer's wall clock."""
    return F.timestamp_add("MINUTE", offset_minutes, ntz)


def day_key(clock: Column) -> Column:
    return F.date_format(clock, "yyyy-MM-dd")


def week_key(clock: Column) -> Column:
    """ISO year and week without zero padding, e.g. ``2025-W1``."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), clock).cast("string"),
        F.lit("-W"),
        F.weekofyear(clock).cast("string"),
    )


def month_key(clock: Column) -> Column:
    return F.date_format(clock, "yyyy-MM")


def days_text(seconds: Column) -> Column:
    return F.format_string("%.2f days", seconds.cast("double") / F.lit(86400.0))


def rfc3339(seconds: Column, offset_minutes: Column) -> Column:
    """Epoch seconds written in the given offset; NULL prints the zero time."""
    clock = F.timestamp_add(
        "SECOND", seconds + offset_minutes * F.lit(60), F.expr(_EPOCH)
    )
    minutes = F.abs(offset_minutes)
    zone = F.when(offset_minutes == 0, F.lit("Z")).otherwise(
        F.format_string(
            "%s%02d:%02d",
            F.when(offset_minutes < 0, F.lit("-")).otherwise(F.lit("+")),
            F.floor(minutes / 60),
            minutes % 60,
        )
    )
    return F.coalesce(
        F.concat(F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss"), zone), F.lit(ZERO_TIME)
    )
