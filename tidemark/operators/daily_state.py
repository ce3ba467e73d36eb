"""Daily results from partial states that merge (X2 over A1, A4, A5, T1-T3).

A state says of the quotes of one (date, file) what the results of any set of
files need: counts, exact sums and sums of squares, the largest and smallest
rows of three lists, and sums by sector.  States of a date add up in any order,
so a file that arrives later costs its own rows and not those of its date, and a
file that is landed again replaces its state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MEAN_TYPE, MONEY_TYPE, pct, round_half_up
from .joins import null_safe_join
from .topn import top_n

TOP, LARGEST = 20, (10, 50)
#: Changes have eight places, their squares sixteen; the sums of both are exact.
CHANGE_TYPE = "decimal(18,8)"
LISTS = {"gainers": ("change_pct", True, TOP), "losers": ("change_pct", False, TOP), "amounts": ("amount_num", True, max(LARGEST))}


def partial_states(quotes: DataFrame, keys: Sequence[str] = ("trade_date", "source_file"), sector: str = "industry_name") -> dict[str, DataFrame]:
    """Cleaned quotes (code, name, change_pct, amount_num, ``sector`` and the
    keys) -> states by key: ``sums``, ``tops`` (one row per listed stock) and,
    where there is a sector, ``sectors``."""
    keys = list(keys)
    v, amount = F.col("change_pct").cast(MEAN_TYPE), F.col("amount_num").cast(MONEY_TYPE)
    small = F.col("change_pct").try_cast(CHANGE_TYPE)
    sums = quotes.groupBy(*keys).agg(
        F.count_if(F.col("change_pct") > 0).alias("up"), F.count_if(F.col("change_pct") < 0).alias("down"),
        F.count_if(F.col("change_pct") == 0).alias("flat"), F.count(F.lit(1)).alias("n"), F.count(v).alias("n_change"),
        F.sum(v).alias("change"), F.sum(small * small).alias("squares"), F.sum(amount).alias("amount"))
    tops = None
    for name, (value, desc, n) in LISTS.items():
        top = top_n(quotes, value, n, desc=desc, by=keys, cols=[*keys, "code", "name", "change_pct", "amount_num"]).withColumn("list", F.lit(name))
        tops = top if tops is None else tops.unionByName(top)
    states = {"sums": sums, "tops": tops}
    if sector in quotes.columns:
        states["sectors"] = quotes.where(F.col(sector).isNotNull()).groupBy(*keys, sector).agg(
            F.count(F.lit(1)).alias("n"), F.count(v).alias("n_change"), F.sum(v).alias("change"), F.sum(amount).alias("amount"))
    return states


def merged_results(states: Mapping[str, DataFrame], by: Sequence[str] = ("trade_date",), sector: str = "industry_name") -> dict[str, DataFrame]:
    """States -> the result tables that they hold, one row (or list) per ``by``,
    equal to those computed from the quotes themselves."""
    by = list(by)
    total = lambda c: F.sum(c).alias(c)
    s = states["sums"].groupBy(*by).agg(*[total(c) for c in ("up", "down", "flat", "n", "n_change", "change", "squares", "amount")])
    n, x, xx = (F.col(c).cast("double") for c in ("n_change", "change", "squares"))
    std = F.when(F.col("n_change") > 1, F.sqrt(F.greatest(F.lit(0.0), xx - x * x / n) / (n - 1)))
    out = {"market_summary": s.select(
        *by, F.col("up").alias("up_count"), F.col("down").alias("down_count"), F.col("flat").alias("flat_count"), F.col("n").alias("total_count"),
        round_half_up(F.try_divide(x, n), 4).alias("avg_change_pct"), round_half_up(std, 4).alias("std_change_pct"),
        round_half_up(F.col("amount").cast("double"), 0).alias("total_amount"))}
    lists = {k: states["tops"].where(F.col("list") == k) for k in LISTS}
    for name, key, col in (("top_gainers", "gainers", "change_pct"), ("top_losers", "losers", "change_pct")):
        out[name] = top_n(lists[key], col, TOP, desc=LISTS[key][1], by=by, cols=[*by, "code", "name", "change_pct"])
    out["top_amount"] = top_n(lists["amounts"], "amount_num", TOP, by=by, cols=[*by, "code", "name", "amount_num", "change_pct"]).select(
        *by, "code", "name", round_half_up("amount_num", 0).alias("amount"), "change_pct")
    first = top_n(lists["amounts"], "amount_num", max(LARGEST), tiebreak=(), by=by, cols=[*by, "amount_num"], rank_col="_rk") if by else (
        top_n(lists["amounts"], "amount_num", max(LARGEST), tiebreak=(), cols=["amount_num"], rank_col="_rk"))
    held = first.groupBy(*by).agg(*[F.sum(F.when(F.col("_rk") <= k, F.col("amount_num").cast(MONEY_TYPE))).cast("double").alias(f"s{k}") for k in LARGEST])
    whole = s.select(*by, F.col("amount").cast("double").alias("total"))
    joined = null_safe_join(whole, held, by, "left") if by else held.withColumn("total", whole.scalar())
    out["concentration"] = joined.select(*by, *[pct(F.coalesce(F.col(f"s{k}"), F.lit(0.0)), "total").alias(f"top{k}_pct") for k in LARGEST])
    if "sectors" in states:
        g = states["sectors"].groupBy(*by, sector).agg(*[total(c) for c in ("n", "n_change", "change", "amount")])
        out["sector_stats"] = g.select(*by, sector, F.col("n").alias("stock_count"),
                                       round_half_up(F.try_divide(F.col("change").cast("double"), F.col("n_change").cast("double")), 2).alias("avg_change"),
                                       round_half_up(F.col("amount").cast("double"), 0).alias("total_amount"))
    return out
