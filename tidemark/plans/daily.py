"""The daily result tables (stage 2 of the reference), per trade date.

Every table is keyed by ``trade_date`` so one run can compute any number of
days and a rerun of one day replaces only that day.  ``pooled=True`` reproduces
the reference's behaviour of mixing all landed days together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, round_half_up
from ..operators.asof import with_sector_asof
from ..operators.breadth import breadth
from ..operators.clean import clean_quotes, with_bar_return
from ..operators.concentration import concentration
from ..operators.joins import with_sector
from ..operators.rollups import period_mean, range_stats, rollup_by
from ..operators.topn import top_n


def daily_results(quotes_raw: DataFrame, bars: DataFrame, valuation: DataFrame,
                  sector_map: DataFrame | None, pooled: bool = False,
                  top: int = 20) -> dict[str, DataFrame]:
    """The nine result tables.  ``quotes_raw`` needs a ``trade_date`` column
    unless ``pooled``.  The cleaned quotes are the shared input of seven of
    them; callers that write all nine should cache or checkpoint it."""
    by = [] if pooled else ["trade_date"]
    spot = clean_quotes(quotes_raw, keep=tuple(by))
    out: dict[str, DataFrame] = {
        "spot_clean": spot,
        "market_summary": breadth(spot, by=by),
        "top_gainers": top_n(spot, "change_pct", top, desc=True, by=by, cols=[*by, "code", "name", "change_pct"]),
        "top_losers": top_n(spot, "change_pct", top, desc=False, by=by, cols=[*by, "code", "name", "change_pct"]),
        "top_amount": top_n(spot, "amount_num", top, desc=True, by=by,
                            cols=[*by, "code", "name", "amount_num", "change_pct"]).select(
            *by, "code", "name", round_half_up("amount_num", 0).alias("amount"), "change_pct"),
        **undated_results(bars, valuation),
        "concentration": concentration(spot, "amount_num", (10, 50), by=by),
    }
    if sector_map is not None:
        joined = _with_industry(spot, sector_map, by)
        out["sector_stats"] = rollup_by(joined, "industry_name", by=by)
    else:
        schema = ("trade_date date, " if by else "") + "industry_name string, stock_count bigint, avg_change double, total_amount double"
        out["sector_stats"] = spot.sparkSession.createDataFrame([], schema)
    return out


def undated_results(bars: DataFrame, valuation: DataFrame) -> dict[str, DataFrame]:
    """The two tables that have no trade date."""
    return {"pe_by_year": period_mean(valuation, "date", "avg_pe", "year", 2, "avg_pe_val"), "index_stats": range_stats(bars)}


def _with_industry(spot: DataFrame, sector_map: DataFrame, by: list[str]) -> DataFrame:
    """A dated quote gets the industry of the map in force on its date; pooled
    quotes, and maps without dates, that of the latest map."""
    if by and "trade_date" in sector_map.columns:
        return with_sector_asof(spot, sector_map, vendor_codes=True)
    return with_sector(spot, sector_map, key="code", dim="industry", out="industry_name", vendor_codes=True)


def run_daily(spark, raw_dir: str, out_dir: str, pooled: bool = False, fmt: str = "parquet") -> dict[str, str]:
    """Land -> clean once -> nine result tables written under ``out_dir``, and
    ``unmatched_codes`` (how many quotes found no sector) and ``file_account`` (the
    rows read of each quote file, and files that gave none or are cut short).

    Reads ``{raw_dir}/a_spot/*.csv``, ``a_hist``, ``market_pe`` and the
    optional ``industry`` map.  The raw quotes are written once as a table in
    the shared checkpoint folder, so the nine results read that table instead
    of re-parsing CSV nine times.  Returns {table: path}.
    """
    from ..session import materialize
    from ..sinks.writers import write_results
    from ..sources.market import file_account, read_bars, read_quotes, read_sector_map, read_valuation

    raw = raw_dir.rstrip("/")
    read = materialize(read_quotes(spark, f"{raw}/a_spot/*.csv", source=True), "daily-quotes")
    quotes = read.drop("source_path")
    tables = daily_results(
        quotes, read_bars(spark, f"{raw}/a_hist/*.csv"), read_valuation(spark, f"{raw}/market_pe/*.csv"),
        read_sector_map(spark, f"{raw}/industry/*.csv"), pooled=pooled)
    by_date = None if pooled else "trade_date"
    sectors = read_sector_map(spark, f"{raw}/industry/*.csv")
    spot = tables["spot_clean"]
    matched = _with_industry(spot, sectors, [] if pooled else ["trade_date"])
    tables["unmatched_codes"] = matched.groupBy(*([] if pooled else ["trade_date"])).agg(
        F.count_if(F.col("industry_name").isNull()).alias("unmatched"), F.count(F.lit(1)).alias("quotes"))
    tables["file_account"] = file_account(spark, f"{raw}/a_spot/*.csv", read)
    write_results(tables, out_dir, fmt=fmt, partition_by=by_date)
    return {k: f"{out_dir.rstrip('/')}/{k}" for k in tables}


def index_extras(bars: DataFrame) -> DataFrame:
    """Last close and mean bar return, which the technical text asks for."""
    b = with_bar_return(bars)
    return b.agg(F.max_by("close", "date").alias("close"), round_half_up(exact_mean("change_pct"), 2).alias("avg_change_pct"))
