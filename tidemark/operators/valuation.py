"""Valuation position (A6): where the latest period mean sits among all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, round_half_up
from .joins import null_safe_join


def valuation_position(periods: DataFrame, order: str = "year", value: str = "avg_pe_val",
                       by: Sequence[str] = ()) -> DataFrame:
    """current (value of the latest period), max, min, mean (4dp) and percentile.

    percentile = 100 * share of periods whose value is strictly below current,
    the current period included in the denominator (so it never reaches 100),
    1dp.  ``current`` is max_by(value, order): with ``by`` it is joined back on
    the group keys; overall it is a scalar subquery.
    """
    v = F.col(value)
    if by:
        cur = periods.groupBy(*by).agg(F.max_by(v, F.col(order)).alias("current"))
        j = null_safe_join(periods, cur, by)
    else:
        j = periods.withColumn("current", periods.agg(F.max_by(v, F.col(order))).scalar())
    return j.groupBy(*by).agg(
        F.max("current").alias("current"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        round_half_up(exact_mean(v), 4).alias("mean"),
        round_half_up(F.count_if(v < F.col("current")).cast("double") / F.count(F.lit(1)) * 100, 1).alias("percentile"),
    )
