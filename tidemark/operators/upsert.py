"""Keyed upsert into the knowledge base (K5).

Precedence: inside one batch the first row per key wins (file order); across
batches the later batch wins, and of equal versions the update.  All steps are
partial aggregates (min / max of a struct), so a key repeated in a third of all
rows never lands whole on one reducer.  The table is stored hash-bucketed by key
so an upsert rewrites only the buckets the batch touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .news import dedupe_first


def _greatest(rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``by``, ties by the other values."""
    rest = [c for c in rows.columns if c != key and c not in by]
    picked = rows.groupBy(key).agg(F.max(F.struct(*by, *rest)).alias("_w"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_w.{c}").alias(c) for c in rows.columns])


def upsert_latest(base: DataFrame | None, updates: DataFrame, key: str, version: str,
                  order: Sequence[str] = (), stored_order: bool = False) -> DataFrame:
    """Merged table: ``base`` with every key of ``updates`` replaced.

    ``version`` orders batches (later wins); ``order`` orders rows inside a
    batch (first wins).  A stored row stays only if its version is greater than
    the update's: an update of the same version replaces it, and so does one
    without a version, unless its batch has one with a version.  An empty
    ``updates`` leaves ``base`` unchanged.

    ``stored_order``: ``order`` is stored with the rows and orders rows of a
    version across batches, too, so that the table doesn't depend on how rows
    were packed into batches (the first row of a version stays).
    """
    if stored_order:
        rows = updates if base is None else base.select(*updates.columns).unionByName(updates)
        return _greatest(dedupe_first(rows, [key, version], list(order)), key, [version]).select(*updates.columns)
    first = dedupe_first(updates, [key, version], list(order)) if order else updates
    new = _greatest(first, key, [version])
    if base is None:
        return new
    cols = new.columns
    marked = base.select(*cols, F.lit(0).alias("_free"), F.lit(0).alias("_new")).unionByName(
        new.select(*cols, F.when(F.col(version).isNull(), 1).otherwise(0).alias("_free"), F.lit(1).alias("_new")))
    return _greatest(marked, key, ["_free", version, "_new"]).select(*cols)


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when nothing is there yet.  Any
    other failure (an unreadable file, no permission) is raised: taking it for
    an empty table would lose its rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def drop_partitions(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """Delete partition folders (``bucket=3``) that have no rows any more, which
    a dynamic overwrite leaves as they are."""
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_buckets(spark: SparkSession, path: str, base: DataFrame, bucket_by: str, asked: int) -> int | None:
    """How many buckets the table has: its note ``_layout``; without a note the
    number asked for, if every row lies where that number puts it, else None."""
    note = read_if_there(spark, f"{path.rstrip('/')}/_layout")
    if note is not None:
        return note.first()[0]
    return asked if base.where(F.col("bucket") != bucket_of(bucket_by, asked)).isEmpty() else None


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, key: str, version: str,
                 order: Sequence[str] = (), buckets: int = 64, bucket_by: str | None = None, stored_order: bool = False) -> list[int]:
    """Upsert ``updates`` into the Parquet table at ``path`` (bucket-partitioned),
    and return the buckets that were written.

    Only buckets that receive updates are read and rewritten (dynamic partition
    overwrite).  A table stored with another number of buckets is dealt anew,
    whole.  The merged buckets are first written to a staging table of this
    call's own in the shared checkpoint folder, so the job never reads and
    overwrites the same files and a lost executor only reruns tasks.  The table
    has one writer at a time: Parquet folders have no commit that two could
    share.  ``bucket_by``: the column that buckets go by, if not the key; a key
    keeps its value of it.
    """
    by = bucket_by or key
    upd = updates.withColumn("bucket", bucket_of(by, buckets))
    base = read_if_there(spark, path)
    stored = buckets if base is None else stored_buckets(spark, path, base, by, buckets)
    anew = stored != buckets
    if anew:
        base = base.withColumn("bucket", bucket_of(by, buckets))
    elif base is not None:
        touched = upd.select("bucket").distinct()  # at most `buckets` rows
        base = base.join(touched, "bucket", "left_semi")
    merged = upsert_latest(base, upd, key, version, order, stored_order)
    staging = scratch_path(spark, "upsert-staging")
    merged.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("bucket").parquet(staging)
    staged = spark.read.schema(merged.schema).parquet(staging)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "static" if anew else "dynamic")
     .partitionBy("bucket").parquet(path))
    if anew or read_if_there(spark, f"{path.rstrip('/')}/_layout") is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_layout")
    return sorted(r[0] for r in staged.select("bucket").distinct().collect())
