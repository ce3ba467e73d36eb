"""Market breadth (A1): one row per group (or one row overall)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, money_sum, round_half_up


def breadth(df: DataFrame, value: str = "change_pct", amount: str = "amount_num",
            by: Sequence[str] = ()) -> DataFrame:
    """up/down/flat counts, total, mean (4dp), sample stddev (4dp), total amount (0dp).

    A single hash aggregate with a map-side partial step, so a hot date or
    sector costs one partial row per task, not a hot reducer.  Pass ``by``
    (e.g. ``trade_date``) to get one row per day instead of pooling days.
    """
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count_if(v > 0).cast("long").alias("up_count"),
        F.count_if(v < 0).cast("long").alias("down_count"),
        F.count_if(v == 0).cast("long").alias("flat_count"),
        F.count(F.lit(1)).alias("total_count"),
        round_half_up(exact_mean(v), 4).alias("avg_change_pct"),
        round_half_up(F.stddev_samp(v), 4).alias("std_change_pct"),
        round_half_up(money_sum(amount), 0).alias("total_amount"),
    )
