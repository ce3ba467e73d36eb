"""Ranking of every row (W1) and whole-frame totals (W2) without a single-partition window.

``ROW_NUMBER() OVER (ORDER BY ...)`` with no partition sends every row through
one task.  Here the rows are range-partitioned on the ordering (one shuffle,
sampled bounds), numbered inside each partition, and shifted by the row counts
of the earlier partitions.  With ``by`` the range partitioning is on
(by..., order...), so a group holding a third of all rows is spread over many
tasks; the offsets are per (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import money_sum
from .joins import null_safe_join


def row_number_by(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (),
                  out: str = "rn", partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number over ``order`` (a total order), per ``by`` group."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(b).asc() for b in by] + list(order)
    laid = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # Pin the layout (reliable checkpoint in the shared folder): the counts and
    # the numbering below must see the same partitions, also after a lost task.
    laid = laid.checkpoint(eager=True)
    gkeys = ["_pid", *by]
    counts = laid.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # offsets has one row per (partition, group) pair present: at most
    # partitions + groups rows, because range partitions hold contiguous groups.
    numbered = null_safe_join(laid, offsets.select(*gkeys, "_off", "_first"), gkeys)
    rn = F.col("_off") + (F.col("_mid") - F.col("_first")) + F.lit(1)
    return numbered.withColumn(out, rn.cast("long")).drop("_pid", "_mid", "_off", "_first")


def with_total(df: DataFrame, measure: str, out: str = "total", by: Sequence[str] = ()) -> DataFrame:
    """Attach the (group) total of a money column to every row."""
    if by:
        totals = df.groupBy(*by).agg(money_sum(measure).alias(out))
        return null_safe_join(df, totals, by)
    return df.withColumn(out, df.agg(money_sum(measure)).scalar())
