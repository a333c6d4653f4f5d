"""Time expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two accepted time forms.
TWO_FIELDS = r"\A(\p{Nd}+):(\p{Nd}{2})\z"
THREE_FIELDS = r"\A(\p{Nd}+):(\p{Nd}{2}):(\p{Nd}{2})\z"
PROBE_DURATION = r"(?i)Duration:(?U:\s)*(\p{Nd}+):(\p{Nd}+):(\p{Nd}+(?:\.\p{Nd}+)?)"


def format_seconds(seconds: Column) -> Column:
    """``MM:SS``, or ``H:MM:SS`` from one hour on."""
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes, secs = (F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    short = F.concat_ws(":", two(minutes), two(secs))
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), short)).otherwise(short)


def format_timestamp(ms: Column) -> Column:
    return format_seconds(F.greatest(F.lit(0).cast("bigint"), F.floor(ms / 1000).cast("bigint")))


#: Decimal digits of all scripts, and their values.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
VALUES = "".join(str(int(c)) for c in DIGITS)


def plain_digits(text: Column) -> Column:
    """Decimal digits of any script as 0 to 9. Text within ASCII is not translated."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, DIGITS, VALUES)).otherwise(text)


def parse_timestamp(text: Column) -> Column:
    """Whole-string match of either form in seconds, else null; so are seconds beyond 64 bits."""
    part = lambda pattern, i: plain_digits(F.regexp_extract(text, pattern, i)).try_cast("bigint")
    times = lambda c, n: F.try_multiply(c, F.lit(n).cast("bigint"))
    return F.when(
        text.rlike(TWO_FIELDS), F.try_add(times(part(TWO_FIELDS, 1), 60), part(TWO_FIELDS, 2))
    ).when(
        text.rlike(THREE_FIELDS),
        F.try_add(times(part(THREE_FIELDS, 1), 3600), times(part(THREE_FIELDS, 2), 60) + part(THREE_FIELDS, 3)),
    )


def parse_probe_duration(text: Column) -> Column:
    """Seconds of the first ``Duration: H:M:S`` in probe output, else null."""
    part = lambda i: plain_digits(F.regexp_extract(text, PROBE_DURATION, i)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    return F.when(duration != 0, F.bround(elapsed / duration, 6))


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of an ISO time; without an offset it is UTC (the session zone); bad text is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp").cast("double"))


def estimate_seconds(duration: Column, size: Column) -> Column:
    """Expected processing time; null without a duration."""
    seconds = (
        F.lit(30.0)
        + F.greatest(F.lit(0.0), duration) * 0.30
        + F.greatest(F.lit(0), F.coalesce(size, F.lit(0))) / (8 * 1024 * 1024)
    )
    return F.when(duration.isNotNull(), F.ceil(seconds).cast("bigint"))
