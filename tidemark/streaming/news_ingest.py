"""Incremental news ingest with Structured Streaming.

New JSONL drops in a directory are picked up exactly once (the checkpoint
records which files were processed), malformed lines go to a quarantine table,
and each micro-batch is shaped into knowledge-base rows and upserted by key.
``trigger(availableNow=True)`` processes what is there and stops, so the daily
job is a bounded run that survives restarts: a rerun with nothing new adds
nothing.

The answer doesn't depend on how files are packed into micro-batches.  The first
article of each (id, day), by file and place in the file, is kept in a table of
its own beside the knowledge base, short ones included: a day's first article
may arrive after a later one, and may be too short to be shown.  The knowledge
base is what that table says of the ids that a batch touches: of each id, the
article of its latest day that has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.news import first_articles, long_enough
from ..operators.upsert import bucket_of, drop_partitions, upsert_latest, upsert_table
from ..session import scratch_path
from ..sources.news import parse_news_lines

#: Where an article stands: its file, the start of the split that its line came
#: from, and its place among the rows read from that split.
ORDER = ("file", "block", "place")


def news_stream(spark: SparkSession, source_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming lines of the news drops with the path of their file."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source_dir)
    tagged = lines.withColumn("file", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start"))
    return parse_news_lines(tagged)


def publish(spark: SparkSession, days_path: str, kb_path: str, buckets: list[int], layout: int) -> None:
    """Rewrite the given buckets of the knowledge base from the table of days."""
    days = spark.read.parquet(days_path).where(F.col("bucket").isin(buckets) & F.col("shown")).drop("_key", "shown", "bucket", *ORDER)
    kb = upsert_latest(None, days, "id", "batch_date").withColumn("bucket", bucket_of("id", layout))
    staging = scratch_path(spark, "kb-staging")
    kb.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("bucket").parquet(staging)
    staged = spark.read.schema(kb.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(kb_path)
    full = {r[0] for r in staged.select("bucket").distinct().collect()}
    drop_partitions(spark, kb_path, [f"bucket={b}" for b in buckets if b not in full])


def ingest_news(spark: SparkSession, source_dir: str, kb_path: str, quarantine_path: str,
                checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None,
                buckets: int = 64, files_per_batch: int = 1000):
    """Start the availableNow ingest; returns the StreamingQuery (call awaitTermination()).

    ``embed`` maps a frame with a ``document`` column to one with an
    ``embedding`` column (e.g. ``lambda d: hash_embed(d, "document")``); it is
    called on the new articles only.  The batch date of an article is its
    ``crawl_date``, or the date in its file's name.  ``{kb_path}-days`` holds the
    first article of each id and day.
    """
    parsed = news_stream(spark, source_dir, files_per_batch)
    days_path = f"{kb_path.rstrip('/')}-days"

    def handle(batch: DataFrame, epoch: int) -> None:
        # Read once for both outputs; a batch that is tried again replaces its own quarantine.
        batch = batch.persist()
        bad = batch.where(F.col("_bad").isNotNull()).select(F.col("_bad").alias("line"), "file", "block")
        bad.write.mode("overwrite").parquet(f"{quarantine_path.rstrip('/')}/epoch={epoch}")
        good = batch.where(F.col("_bad").isNull()).drop("_bad").withColumn("place", F.monotonically_increasing_id())
        day = F.coalesce(F.col("crawl_date"), F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d{8})", 1))
        first = first_articles(good.withColumn("_day", day), F.col("_day"), order=list(ORDER)).withColumn("shown", long_enough())
        rows = first.where("shown")
        rows = (embed(rows) if embed is not None else rows).unionByName(first.where("not shown"), allowMissingColumns=True)
        rows = rows.withColumn("_key", F.concat_ws("#", "id", "batch_date"))
        written = upsert_table(spark, days_path, rows, key="_key", version="batch_date", order=list(ORDER), buckets=buckets,
                               bucket_by="id", stored_order=True)
        if written:
            publish(spark, days_path, kb_path, written, buckets)
        batch.unpersist()

    return (parsed.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())
