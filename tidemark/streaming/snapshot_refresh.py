"""Per-trade-date refresh of the daily results.

Quote drops are streamed from the landing directory.  Each file lands in a
partition of its own (trade date, file), so a file replaces only what it brought
before, and a date may arrive in any number of files and micro-batches.  What
the result tables need of a file is landed beside it as a state of a few rows;
the results of the dates in a batch are then merged from the states of all their
files, so a new file doesn't recompute its date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.asof import with_sector_asof
from ..operators.clean import clean_quotes
from ..operators.daily_state import merged_results, partial_states
from ..operators.joins import with_sector
from ..operators.upsert import read_if_there
from ..plans.daily import undated_results
from ..sinks.writers import write_daily, write_results

KEYS = ("trade_date", "source_file")


def land_states(landed_path: str, states: dict[str, DataFrame]) -> None:
    for name, df in states.items():
        write_daily(df, f"{landed_path.rstrip('/')}-state/{name}", list(KEYS))


def read_states(spark: SparkSession, landed_path: str) -> dict[str, DataFrame]:
    found = {name: read_if_there(spark, f"{landed_path.rstrip('/')}-state/{name}") for name in ("sums", "tops", "sectors")}
    return {name: df for name, df in found.items() if df is not None}


def refresh_daily(spark: SparkSession, quotes_dir: str, landed_path: str, results_path: str,
                  checkpoint: str, bars: DataFrame, valuation: DataFrame,
                  sector_map: DataFrame | None = None, quarantine_path: str | None = None):
    """Start the availableNow refresh; returns the StreamingQuery.

    Raw quotes land under ``landed_path``, their states under
    ``{landed_path}-state``.  Cleaned quotes are a result by date and file; the
    other dated results are merged per date; the two tables that have no date
    are rebuilt whole.  A sector is that of the map in force on the trade date
    when a file lands.  Files are told apart by their path.  Files whose name
    holds no valid date go to ``quarantine_path`` (default: beside the landed
    table) and don't stop the stream.
    """
    name = F.col("_metadata.file_name")
    day = F.try_to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd")
    stream = (spark.readStream.schema(schemas.QUOTES_RAW).option("header", "true").csv(quotes_dir)
              .withColumn("trade_date", day).withColumn("source_file", F.concat_ws("-", name, F.md5(F.col("_metadata.file_path").cast("binary")))))
    undated = quarantine_path or f"{landed_path.rstrip('/')}-undated"

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        (batch.where("trade_date is null").write.mode("overwrite").parquet(f"{undated.rstrip('/')}/epoch={epoch}"))
        dated = batch.where("trade_date is not null")
        write_daily(dated, landed_path, list(KEYS))
        days = dated.select("trade_date").distinct()  # one row per date in the batch
        if not days.isEmpty():
            spot = clean_quotes(dated, keep=KEYS)
            write_daily(spot, f"{results_path.rstrip('/')}/spot_clean", list(KEYS))
            if sector_map is not None and "trade_date" in sector_map.columns:
                spot = with_sector_asof(spot, sector_map, vendor_codes=True)
            elif sector_map is not None:
                spot = with_sector(spot, sector_map, vendor_codes=True)
            land_states(landed_path, partial_states(spot, KEYS))
            states = {k: df.join(days, "trade_date", "left_semi") for k, df in read_states(spark, landed_path).items()}
            tables = merged_results(states) | undated_results(bars, valuation)
            write_results(tables, results_path, partition_by="trade_date")
        batch.unpersist()

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
