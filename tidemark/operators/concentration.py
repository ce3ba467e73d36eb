"""Turnover concentration (A5, A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_TYPE, money_sum, pct
from .joins import null_safe_join
from .topn import top_n


def concentration(df: DataFrame, measure: str = "amount_num", ns: Sequence[int] = (10, 50),
                  by: Sequence[str] = ()) -> DataFrame:
    """Share (%) of the total held by the n largest rows, for each n in ``ns``.

    Overall: one ORDER BY ... LIMIT max(ns) (per-task top-k, one small merge)
    plus one total aggregate, combined through scalar subqueries; no global
    window and no single-partition shuffle of raw rows.  Sums of the top rows
    do not depend on how ties are broken.

    With ``by``: top-max(ns) per group through a partial WindowGroupLimit,
    joined on the group keys with the per-group totals.  0 when a total is
    not positive.
    """
    nmax = max(ns)
    m = F.col(measure)
    if not by:
        top = df.select(measure).where(m.isNotNull()).orderBy(m.desc()).limit(nmax)
        arr = top.agg(F.sort_array(F.collect_list(m.cast(MONEY_TYPE)), asc=False).alias("a"))
        zero = F.lit(0).cast("decimal(38,2)")
        sums = arr.select(*[
            F.aggregate(F.slice("a", 1, n), zero, lambda acc, x: acc + x).cast("double").alias(f"s{n}")
            for n in ns
        ])
        total = df.agg(money_sum(measure).alias("total"))
        with_total = sums.withColumn("total", total.scalar())
        return with_total.select(*[pct(f"s{n}", "total").alias(f"top{n}_pct") for n in ns])

    ranked = top_n(df.select(*by, measure), measure, nmax, tiebreak=(), by=by, rank_col="_rk")
    sums = ranked.groupBy(*by).agg(*[
        F.sum(F.when(F.col("_rk") <= n, m.cast(MONEY_TYPE))).cast("double").alias(f"s{n}") for n in ns
    ])
    totals = df.groupBy(*by).agg(money_sum(measure).alias("total"))
    joined = null_safe_join(totals, sums, by, "left")
    return joined.select(*by, *[pct(F.coalesce(F.col(f"s{n}"), F.lit(0.0)), "total").alias(f"top{n}_pct") for n in ns])
