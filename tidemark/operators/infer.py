"""Batch inference over a prompt table.

The model call is a user-supplied function; each row gets its answer or its
error message (one failing prompt does not fail the job).  No transport is built
in.  ``infer`` calls every row; ``infer_resumable`` calls each distinct prompt
that a store of answers doesn't hold.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .upsert import read_if_there

#: Tries of one call, and the first wait in seconds, which doubles.
TRIES, FIRST_WAIT = 3, 1.0


def infer(df: DataFrame, fn: Callable[[str, str], str], system: str = "system", user: str = "user",
          out: str = "raw") -> DataFrame:
    """Add ``raw`` (the answer text) and ``error`` (null when the call succeeded)."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType(list(df.schema.fields)).add(out, StringType()).add("error", StringType())
    cols = df.columns

    def run(frames):
        for pdf in frames:
            answers, errors = [], []
            for s, u in zip(pdf[system].tolist(), pdf[user].tolist()):
                try:
                    answers.append(fn(s, u))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - recorded per row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            res = pdf[cols].copy()
            res[out] = pd.Series(answers, index=pdf.index, dtype=object)
            res["error"] = pd.Series(errors, index=pdf.index, dtype=object)
            yield res

    return df.mapInPandas(run, schema)


def tried(fn: Callable, args: tuple, tries: int, first_wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str | None, int]:
    """(answer, error, tries made): up to ``tries`` calls with doubling waits between them."""
    for n in range(1, tries + 1):
        try:
            return fn(*args), None, n
        except Exception as e:  # noqa: BLE001 - the last one is the row's error
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            sleep(first_wait * 2 ** (n - 1))
    return None, error, tries


def prompt_key(system: str = "system", user: str = "user") -> Column:
    """sha256 of both prompts, each behind its length; a null counts as empty."""
    s, u = (F.coalesce(F.col(c), F.lit("")) for c in (system, user))
    return F.sha2(F.concat(F.length(s).cast("string"), F.lit(":"), s, F.lit(":"), u).cast("binary"), 256)


ANSWERS = "key string, raw string, error string, tries int"
_ARROW = pa.schema([("key", pa.string()), ("raw", pa.string()), ("error", pa.string()), ("tries", pa.int32())])


def _shared(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(folder: str, name: str, rows: list[tuple]) -> None:
    """One file of answers, whole or not at all: written under a hidden name, then renamed."""
    store, at = _shared(folder)
    store.create_dir(at, recursive=True)
    pq.write_table(pa.Table.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW), f"{at}/.{name}", filesystem=store)
    store.move(f"{at}/.{name}", f"{at}/{name}")


def _answered(folder: str, prefix: str) -> set[str]:
    store, at = _shared(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(prefix)]
    return {k for f in files for k in pq.read_table(f, columns=["key"], filesystem=store)["key"].to_pylist()}


def read_answers(spark: SparkSession, store_path: str) -> DataFrame:
    """The store, one row per key: an answer before an error, ties by value."""
    rows = read_if_there(spark, store_path)
    if rows is None:
        return spark.createDataFrame([], ANSWERS)
    return rows.groupBy("key").agg(F.max(F.struct(F.col("raw").isNotNull().alias("_ok"), "raw", "error", "tries")).alias("_a")).select("key", "_a.raw", "_a.error", "_a.tries")


def infer_resumable(df: DataFrame, fn: Callable[[str, str], str], store_path: str, system: str = "system", user: str = "user", out: str = "raw",
                    concurrency: int = 8, tries: int = TRIES, first_wait: float = FIRST_WAIT, flush: int = 32) -> DataFrame:
    """``df`` with ``raw`` and ``error``, calling only prompts without a stored answer.

    Each distinct prompt is called once, by up to ``concurrency`` threads in a
    task and ``tries`` times with doubling waits.  A task writes what it has
    every ``flush`` calls, and when it fails, to the store (a folder that all
    executors share), so a run that is cut short and started again calls only
    what isn't there; a task that Spark tries again skips what its earlier
    attempt wrote.  Only an executor that dies without a word loses calls, up to
    ``flush`` a task.  Prompts that failed to the last try are kept with their
    error and called again by the next run.
    """
    spark = df.sparkSession
    asked = df.select(prompt_key(system, user).alias("key"), F.coalesce(F.col(system), F.lit("")).alias("system"), F.coalesce(F.col(user), F.lit("")).alias("user"))
    asked = asked.groupBy("key").agg(F.min("system").alias("system"), F.min("user").alias("user"))
    done = read_answers(spark, store_path).where("raw is not null").select("key")
    pending = materialize(asked.join(done, "key", "left_anti"), "prompts")
    run_id, folder = uuid.uuid4().hex, store_path.rstrip("/")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        prefix, files, held = f"{run_id}-{task.partitionId()}-", 0, []
        had = _answered(folder, prefix) if task.attemptNumber() else set()

        def put() -> None:
            nonlocal files, held
            if held:
                _write(folder, f"{prefix}{task.attemptNumber()}-{files}.parquet", held)
                files, held = files + 1, []

        n = 0
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                rows = [r for r in b.to_pylist() if r["key"] not in had]
                for at in range(0, len(rows), flush):
                    calls = {pool.submit(tried, fn, (r["system"], r["user"]), tries, first_wait): r["key"] for r in rows[at: at + flush]}
                    broken = None
                    for call in as_completed(calls):
                        try:
                            held.append((calls[call], *call.result()))
                        except BaseException as e:  # noqa: BLE001 - the others' answers are kept first
                            broken = e
                    n += len(held)
                    put()
                    if broken is not None:
                        raise RuntimeError(f"inference stopped by {type(broken).__name__}: {broken}") from broken
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    pending.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    got = read_answers(spark, store_path).select(F.col("key").alias("_key"), F.col("raw").alias(out), "error")
    return df.drop(out, "error").withColumn("_asked", prompt_key(system, user)).join(got, F.col("_asked") == F.col("_key"), "left").drop("_asked", "_key")
