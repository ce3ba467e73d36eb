"""Sinks (K1, K2, K4, K6, K7).

Results are written as Parquet by default, one directory per table, with the
write parallelism of the data (no ``coalesce(1)``); daily inputs and outputs
are partitioned by date and replaced with dynamic partition overwrite, so a
rerun of one day rewrites only that day and a crashed job leaves the other
days untouched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Display order of the result tables (T4).
RESULT_ORDER = {
    "pe_by_year": [("year", True)],
    "sector_stats": [("avg_change", False), ("industry_name", True)],
    "top_gainers": [("change_pct", False), ("code", True)],
    "top_losers": [("change_pct", True), ("code", True)],
    "top_amount": [("amount", False), ("code", True)],
}


def write_results(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet",
                  partition_by: str | None = None, single_file: bool = False,
                  order: Mapping[str, list[tuple[str, bool]]] = RESULT_ORDER) -> None:
    """Write every result table under ``path/<name>`` (K1).

    Tables named in ``order`` are sorted at the sink only (a range-partitioned
    sort; the files keep the order).  A dated table is dealt by (date, order
    keys) ranges first: a date lies in one file or a few neighbouring ones, in
    order, instead of in one file per task, and a big date is split.  ``single_file`` (CSV hand-off to a
    spreadsheet) is the only case that reduces to one task; only use it for
    small, already-aggregated tables.
    """
    for name, df in tables.items():
        out = df
        if name in order:
            keys = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order[name] if c in df.columns]
            if partition_by and partition_by in df.columns:
                out = out.repartitionByRange(F.col(partition_by), *keys).sortWithinPartitions(F.col(partition_by), *keys)
            elif keys:
                out = out.orderBy(*keys)
        out = out.coalesce(1) if single_file else out
        w = out.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        if partition_by and partition_by in df.columns:
            w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
        w.save(f"{path.rstrip('/')}/{name}")


def write_daily(df: DataFrame, path: str, date_col: str | Sequence[str] = "trade_date", fmt: str = "parquet") -> None:
    """Land a daily table partitioned by date (or by date and more); a rerun
    replaces only its partitions (K2, K4).  Rows are rebalanced by partition
    first, so that a date is a few files of Spark's advisory size, not one for
    each task; Spark splits a big one."""
    cols = [date_col] if isinstance(date_col, str) else list(date_col)
    (df.hint("rebalance", *[F.col(c) for c in cols]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*cols).format(fmt).save(path))


def write_news_jsonl(df: DataFrame, path: str) -> None:
    """News as UTF-8 JSON lines per crawl date, non-ASCII kept as-is (K4)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("ignoreNullFields", "false").partitionBy("crawl_date").json(path))


def write_reports(reports: DataFrame, markdown: DataFrame, path: str, date_col: str = "report_date") -> None:
    """Reports as JSON rows and Markdown text, both partitioned by date (K6)."""
    (reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(date_col).json(f"{path.rstrip('/')}/json"))
    (markdown.select(date_col, F.col("markdown").alias("value")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(date_col).text(f"{path.rstrip('/')}/markdown"))


def write_eval_cards(cards: DataFrame, path: str, date_col: str = "date") -> None:
    """Daily evaluation cards, one partition per date (K7)."""
    write_daily(cards, path, date_col, "json")
