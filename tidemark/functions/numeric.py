"""Numeric column helpers (all JVM-side expressions).

Rounding policy: doubles are rounded through DECIMAL so the result is half-up
and does not depend on the binary representation (1.005 -> 1.01).  Money sums
go through DECIMAL so they do not depend on the order rows reach the
aggregate; the single division happens once, in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Decimal shapes used for exact money sums and for rounding.
MONEY_TYPE = "decimal(18,2)"
ROUND_TYPE = "decimal(38,8)"
MEAN_TYPE = "decimal(30,8)"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: ColumnOrName) -> Column:
    """Lenient numeric coercion: bad text -> null, NaN -> null."""
    x = col(c).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def round_half_up(c: ColumnOrName, digits: int) -> Column:
    """ROUND through DECIMAL; result DOUBLE, never -0.0."""
    return F.round(col(c).cast(ROUND_TYPE), digits).cast("double")


def money_sum(c: ColumnOrName) -> Column:
    """Order-independent sum of a money column, as DOUBLE."""
    return F.sum(col(c).cast(MONEY_TYPE)).cast("double")


def exact_mean(c: ColumnOrName, cast_type: str = MEAN_TYPE) -> Column:
    """Order-independent mean: DECIMAL sum divided once by the count."""
    return F.try_divide(F.sum(col(c).cast(cast_type)).cast("double"), F.count(col(c)).cast("double"))


def pct(part: ColumnOrName, whole: ColumnOrName, digits: int = 2, zero_when_empty: bool = True) -> Column:
    """100*part/whole rounded; 0 when the whole is not positive (or null if asked)."""
    ratio = round_half_up(F.try_divide(col(part), col(whole)) * F.lit(100.0), digits)
    if zero_when_empty:
        return F.when(col(whole) > 0, ratio).otherwise(F.lit(0.0))
    return F.when(col(whole) > 0, ratio)
