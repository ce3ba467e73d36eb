"""JSONL news source with a quarantine for malformed lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def parse_news_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines -> news columns plus ``_bad`` (raw line when it is not a JSON object).

    Blank lines are dropped.  Used by the batch reader and the stream.
    """
    v = F.col(value)
    nonblank = lines.where(F.trim(v) != "")
    parsed = F.from_json(v, schemas.NEWS_WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = nonblank.withColumn("_p", parsed)
    fields = [c.split()[0] for c in schemas.NEWS.split(", ")]
    ok = F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull() & F.trim(v).startswith("{")
    keep = [c for c in out.columns if c not in (value, "_p")]
    return out.select(
        *keep,
        *[F.col(f"_p.{f}").alias(f) for f in fields],
        F.when(~ok, v).alias("_bad"),
    )


def read_news(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) frames of a JSONL drop.

    A line that is not a JSON object goes to ``quarantine`` with its raw text
    and file name instead of failing the job.  A missing path gives two empty
    frames (a day with no news is not an error).
    """
    try:
        lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    except AnalysisException:
        return (spark.createDataFrame([], schemas.NEWS + ", file string"),
                spark.createDataFrame([], "line string, file string"))
    parsed = parse_news_lines(lines)
    good = parsed.where(F.col("_bad").isNull()).drop("_bad")
    bad = parsed.where(F.col("_bad").isNotNull()).select(F.col("_bad").alias("line"), "file")
    return good, bad
