"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col

# The compact day format of file names and the history window.
COMPACT_FORMAT = "yyyyMMdd"
HISTORY_DAYS = 365


def compact_date(c: ColumnOrName) -> Column:
    """DATE -> 'YYYYMMDD'."""
    return F.date_format(col(c), COMPACT_FORMAT)


def parse_compact(c: ColumnOrName) -> Column:
    """'YYYYMMDD' -> DATE; anything else -> null."""
    return F.try_to_date(col(c), COMPACT_FORMAT)


def history_start(c: ColumnOrName, days: int = HISTORY_DAYS) -> Column:
    """First day of the trailing history window ending at ``c``."""
    return F.date_sub(col(c), days)


def year_of(c: ColumnOrName) -> Column:
    """Calendar year of a DATE/TIMESTAMP, or of the first four characters of text."""
    x = col(c)
    return F.coalesce(F.year(F.try_to_date(x.cast("string"))), F.substring(x.cast("string"), 1, 4).try_cast("int"))
