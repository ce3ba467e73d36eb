"""Readers for the landed market files.

Every reader takes an explicit schema (no inference, no positional renames) and
returns a lazy DataFrame.  Daily files are partitioned by date so a date filter
prunes whole directories.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pyspark.errors import AnalysisException

from .. import schemas
from ..functions.numeric import to_double

_DATE_IN_NAME = r"(\d{8})"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Header CSV with an explicit schema; None when the path matches nothing."""
    try:
        return (
            spark.read.schema(schema)
            .option("header", "true")
            .option("mode", "PERMISSIVE")
            .option("ignoreCorruptFiles", "true")
            .csv(path)
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_quotes(spark: SparkSession, path: str, source: bool = False) -> DataFrame:
    """Quote CSVs (header, 14 columns).  ``trade_date`` comes from the file name,
    null where that holds no valid date.  ``source``: also ``source_path``, the
    path of each row's file."""
    df = _csv(spark, path, schemas.QUOTES_RAW)
    if df is None:
        return spark.createDataFrame([], schemas.QUOTES_RAW + ", trade_date date" + (", source_path string" if source else ""))
    df = with_source(df) if source else df
    day = F.regexp_extract(F.col("_metadata.file_name"), _DATE_IN_NAME, 1)
    return df.withColumn("trade_date", F.try_to_date(F.nullif(day, F.lit("")), "yyyyMMdd"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Index bars; a typed empty table when nothing was landed."""
    raw = _csv(spark, path, ", ".join(f"{c} string" for c in ["date", "open", "close", "high", "low", "volume", "amount"]))
    if raw is None:
        return spark.createDataFrame([], schemas.BARS)
    return raw.select(
        F.try_to_date(F.col("date")).alias("date"),
        *[to_double(c).alias(c) for c in ["open", "close", "high", "low", "volume", "amount"]],
    )


def read_valuation(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, "date string, index_val string, avg_pe string")
    if raw is None:
        return spark.createDataFrame([], schemas.VALUATION)
    return raw.select(
        F.try_to_date(F.col("date")).alias("date"),
        to_double("index_val").alias("index_val"),
        to_double("avg_pe").alias("avg_pe"),
    )


def read_sector_map(spark: SparkSession, path: str | None) -> DataFrame:
    """code -> industry map; optional input (typed empty table when absent)."""
    df = _csv(spark, path, schemas.SECTOR_MAP) if path is not None else None
    if df is None:
        return spark.createDataFrame([], schemas.SECTOR_MAP + ", trade_date date")
    day = F.regexp_extract(F.col("_metadata.file_name"), _DATE_IN_NAME, 1)
    return df.withColumn("trade_date", F.try_to_date(F.nullif(day, F.lit("")), "yyyyMMdd"))


def file_account(spark: SparkSession, path: str, rows: DataFrame, file_col: str = "source_path") -> DataFrame:
    """One row per file under ``path``: file, bytes, rows read from it, and status
    (S5, what the tolerant read passes over in silence).

    ``rows`` is what was read, with the path of its file in ``file_col`` (see
    ``with_source``).  A file is ``unread`` when it has bytes and gave no row,
    ``cut`` when it gave rows but ends inside a line or a compressed stream, else
    ``read``.  Files without a byte, which Spark's scans pass over, have no row.
    Contents are read by tasks, one file at a time, for the last check only.
    """
    try:
        listed = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "file string, bytes long, rows long, status string")
        raise
    seen = rows.groupBy(F.col(file_col).alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    files = listed.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"), _ends_whole("path", "content").alias("_whole"))
    n = F.coalesce("_rows", F.lit(0))
    status = F.when(n == 0, "unread").when(~F.col("_whole"), "cut").otherwise("read")
    return files.join(seen, F.col("file") == F.col("_file"), "left").select("file", "bytes", n.alias("rows"), status.alias("status"))


def with_source(df: DataFrame, out: str = "source_path") -> DataFrame:
    """A frame that was read from files, with the path of each row's file."""
    return df.withColumn(out, F.col("_metadata.file_path"))


@F.pandas_udf(BooleanType())
def _ends_whole(paths: pd.Series, contents: pd.Series) -> pd.Series:
    """Whether a file ends where a writer would end it: a gzip stream with its
    trailer, a text with the end of a line, Parquet with its mark."""
    def whole(path: str, data: bytes) -> bool:
        if path.endswith(".gz"):
            try:
                while data:
                    stream = zlib.decompressobj(zlib.MAX_WBITS | 16)
                    rest = data
                    while rest and not stream.eof:
                        stream.decompress(rest, 1 << 20)
                        rest = stream.unconsumed_tail
                    if not stream.eof:
                        return False
                    data = stream.unused_data
                return True
            except zlib.error:
                return False
        return data.endswith(b"PAR1") if path.endswith(".parquet") else data.endswith((b"\n", b"\r"))

    return pd.Series([whole(p, bytes(d)) for p, d in zip(paths, contents)])


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A processed result table: the whole directory, never one arbitrary part file."""
    return spark.read.format(fmt).load(path)


def peek(df: DataFrame, n: int = 3) -> DataFrame:
    """A few rows for inspection."""
    return df.limit(n)
