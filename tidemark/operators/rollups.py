"""Group rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, money_sum, round_half_up
from .clean import with_bar_return


def period_mean(df: DataFrame, date_col: str, value: str, period: str = "year",
                digits: int = 2, out: str = "avg_pe_val", by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``value`` per calendar period (A2).  Order-independent mean."""
    if period == "year":
        key = F.year(F.col(date_col)).cast("int").alias("year")
    elif period == "month":
        key = F.date_trunc("month", F.col(date_col)).cast("date").alias("month")
    else:
        raise ValueError(f"unknown period {period!r}")
    return df.groupBy(*by, key).agg(round_half_up(exact_mean(value), digits).alias(out))


def range_stats(bars: DataFrame, close_col: str = "close", open_col: str = "open",
                return_digits: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """close min/max/mean and the sample stddev of the intraday return (A3), 2dp.

    The close statistics use every bar; a bar with a zero or missing open has
    no return and is left out of the volatility only.
    """
    b = with_bar_return(bars, open_col, close_col, "_ret", return_digits)
    return b.groupBy(*by).agg(
        round_half_up(F.min(close_col), 2).alias("close_min"),
        round_half_up(F.max(close_col), 2).alias("close_max"),
        round_half_up(exact_mean(close_col), 2).alias("close_avg"),
        round_half_up(F.stddev_samp("_ret"), 2).alias("volatility"),
    )


def rollup_by(df: DataFrame, dim: str, value: str = "change_pct", amount: str = "amount_num",
              out_dim: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """stock_count, avg_change (2dp), total_amount (0dp) per ``dim`` (A4).

    Rows with a null ``dim`` are not a group.  Ordering is left to the sink.
    """
    return (
        df.where(F.col(dim).isNotNull())
        .groupBy(*by, F.col(dim).alias(out_dim or dim))
        .agg(
            F.count(F.lit(1)).alias("stock_count"),
            round_half_up(exact_mean(value), 2).alias("avg_change"),
            round_half_up(money_sum(amount), 0).alias("total_amount"),
        )
    )


def count_rows(df: DataFrame, out: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Row counts as a table."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
