"""Column expressions that bring dirty values to one spelling. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks at either end, Unicode ones included.
OUTER_BLANKS = r"(?U)^\s+|\s+$"


def present(text: Column) -> Column:
    """The text without outer blanks; null where it is null, empty or blank."""
    trimmed = F.regexp_replace(text, OUTER_BLANKS, "")
    return F.when(trimmed != "", trimmed)


def app_key(app: Column) -> Column:
    """One spelling for an app: lower case, no outer blanks, no trailing ``.exe``; '' when missing."""
    return F.coalesce(present(F.regexp_replace(F.lower(present(app)), r"\.exe$", "")), F.lit(""))


def epoch_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of an epoch number in seconds, milli-, micro- or nanoseconds.

    Null, NaN, infinite, zero and negative numbers are no time and give null. The unit is read off
    the magnitude: seconds stay below 1e11 until the year 5138.
    """
    seconds = (
        F.when(stamp < 1e11, stamp)
        .when(stamp < 1e14, stamp / 1e3)
        .when(stamp < 1e17, stamp / 1e6)
        .otherwise(stamp / 1e9)
    )
    usable = stamp.isNotNull() & ~F.isnan(stamp) & (stamp > 0) & (stamp < 1e20)
    return F.when(usable, F.round(seconds * 1e6).cast("bigint"))
