"""A stored vector index for approximate cosine search (T6), kept up by upserts (K5).

An inverted file with compressed vectors: a bounded sample fits about sqrt(n)
coarse cells and, on the residuals, a codebook for each few dimensions; every
row is then written to its cell with its code (one byte a codebook) and its own
vector.  A query estimates its similarity to the rows of its nearest cells from
their codes, merges a short list, and scores that exactly.

The table is partitioned by cell, so a search reads the codes of the probed
cells and the vectors of their short lists, and an update rewrites the cells
that its rows leave or enter, nothing else.  A cell is a folder, not a group: a
cell with a third of all rows is so many files, read by so many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_half_up
from ..functions.vectors import cosine_distance, l2_normalise, similarity_from_distance
from ..session import materialize, scratch_path
from .rank import row_number_by
from .upsert import drop_partitions, read_if_there, upsert_table

#: Bounds of what the driver fits on: rows of the sample, and cells.
SAMPLE_ROWS, MAX_CELLS = 65_536, 4096
CODE_DIMS, CODES = 4, 256
WAVE_NUMBERS = 1 << 20


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres (fewer for fewer rows); a centre that loses all rows moves to a random one."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.integers(0, len(rows), len(centres))])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[a: a + 4096] @ centres.T - half, axis=1) for a in range(0, max(1, len(rows)), 4096)])


@dataclass
class Model:
    """Cell centres (cells x dims) and one codebook for each ``CODE_DIMS`` dimensions."""

    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        centres = k_means(sample, cells, 10, rng)
        rest = sample - centres[nearest(sample, centres)]
        return cls(centres, [k_means(rest[:, a: a + CODE_DIMS], CODES, 8, rng) for a in range(0, sample.shape[1], CODE_DIMS)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(rows, self.centres)
        rest = rows - self.centres[cell]
        codes = [nearest(rest[:, a: a + CODE_DIMS], book) for a, book in zip(range(0, rows.shape[1], CODE_DIMS), self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        parts = [(m, i, [float(x) for x in row]) for m, a in enumerate([self.centres, *self.books]) for i, row in enumerate(a)]
        spark.createDataFrame(parts, "part int, place int, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/_model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        t = spark.read.parquet(f"{path}/_model").orderBy("part", "place").toPandas()  # bounded by MAX_CELLS and CODES
        arrays = [np.array(g["row"].tolist()) for _, g in t.groupby("part")]
        return cls(arrays[0], arrays[1:])


def _units(docs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row per id (the greatest vector, where several share it); rows
    without an id, and null, empty, zero or non-finite vectors are left out."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.when(fine, v).alias("vec"))
    rows = rows.groupBy("id").agg(F.max("vec").alias("vec"))
    return rows.withColumn("unit", l2_normalise("vec")).where(F.col("unit").isNotNull() & (F.size("unit") > 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_index(units: DataFrame, cells: int | None = None, seed: int = 7) -> Model | None:
    """A model from at most ``SAMPLE_ROWS`` rows, those of the least hash."""
    n, dims, least = units.agg(F.count(F.lit(1)), F.max(F.size("unit")), F.min(F.size("unit"))).first()
    if not n:
        return None
    if dims != least:
        raise ValueError(f"vectors of {least} to {dims} dimensions in one index")
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("unit").toArrow()
    return Model.fit(_matrix(sample["unit"]), cells, seed)


def _encoded(units: DataFrame, model: Model) -> DataFrame:
    shared = units.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_CELLS rows
    schema = T.StructType([units.schema["id"], T.StructField("code", T.BinaryType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, codes = shared.value.encode(_matrix(b.column("unit")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("vec"), pa.array(cell.astype(np.int32))],
                                                 names=["id", "code", "vec", "cell"])

    return units.select("id", "vec", "unit").mapInArrow(run, schema)


def build_index(docs: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None,
                seed: int = 7, model: Model | None = None) -> Model | None:
    """Fit (unless a model is given) and write the index of every row of ``docs``
    under ``path``: ``cells`` (id, code, vec by cell), ``places`` (the cell of
    each id) and the model.  Returns the model; None, and nothing written, for a
    table without vectors."""
    spark = docs.sparkSession
    units = materialize(_units(docs, id_col, vec_col), "index-units")
    model = model or fit_index(units, cells, seed)
    if model is None:
        return None
    model.save(spark, path)
    rows = materialize(_encoded(units, model), "index-rows")
    (rows.hint("rebalance", F.col("cell")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("cell").parquet(f"{path}/cells"))
    upsert_table(spark, f"{path}/places", rows.select("id", "cell", F.lit(0).alias("version")), "id", "version", buckets=16)
    return model


def update_index(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> list[int]:
    """Put the vectors of ``docs`` in the place of those stored under their ids,
    by the stored model, and return the cells that were rewritten: those that a
    row left or entered.  An id whose new vector is no vector keeps its old one.

    Cells are written before the places, so a run that is cut short and tried
    again finds the same cells.
    """
    model = Model.load(spark, path)
    new = materialize(_encoded(_units(docs, id_col, vec_col), model), "index-new")
    places = spark.read.parquet(f"{path}/places").select("id", F.col("cell").alias("_old"))
    left = new.join(places, "id", "left").select(F.explode(F.array_compact(F.array("cell", "_old"))).alias("cell"))
    touched = sorted(r[0] for r in left.distinct().collect())  # cells: at most MAX_CELLS
    if not touched:
        return []
    old = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(touched))  # reads the folders of these cells only
    rows = materialize(old.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new), "index-merged")
    (rows.hint("rebalance", F.col("cell")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/cells"))
    full = {r[0] for r in rows.select("cell").distinct().collect()}
    drop_partitions(spark, f"{path}/cells", [f"cell={c}" for c in touched if c not in full])
    upsert_table(spark, f"{path}/places", new.select("id", "cell", F.lit(0).alias("version")), "id", "version", buckets=16)
    return touched


def _estimates(shared, queries: np.ndarray, numbers: np.ndarray, probed: np.ndarray, short: int):
    """(id, code, cell) rows -> (_q, id, cell, _est): those that may be among the
    ``short`` best of a query, by their codes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        best = np.full((len(queries), short), -np.inf)
        for b in batches:
            cells = b.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for cell in np.unique(cells):
                asked, rows = np.flatnonzero(probed[:, cell]), np.flatnonzero(cells == cell)
                if not len(asked):
                    continue
                est = queries[asked] @ model.decode(cell, codes[rows]).T
                pool = np.concatenate([best[asked], est], axis=1)
                best[asked] = np.partition(pool, pool.shape[1] - short, axis=1)[:, -short:]
                q, at = np.nonzero(est >= best[asked].min(axis=1)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[asked[q]]), b.column("id").take(pa.array(rows[at])), pa.array(np.full(len(q), cell, np.int32)),
                                                  pa.array(est[q, at])], names=["_q", "id", "cell", "_est"])
    return run


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query_id: str = "qid", query_vec: str = "query",
                 probes: int | None = None, short: int | None = None, out_id: str = "doc_id", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(hits, cost).  Hits: query_id, out_id, rank, distance, similarity, as of
    ``cosine_topk``, from the ``probes`` nearest cells (70 %, unless given) and an
    exact score of the ``short`` (8k, unless given) best estimates.  Cost: per
    query the pairs ``estimated`` by codes and ``scored`` exactly, of ``rows``.

    Queries go to the tasks in waves of a bounded number of coordinates.  Null,
    zero and empty queries give no hits.
    """
    model, table = Model.load(spark, path), spark.read.parquet(f"{path}/cells")
    shared = spark.sparkContext.broadcast(model)
    probes, short = probes or math.ceil(0.7 * len(model.centres)), short or 8 * k
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("qvec"))
    q = q.withColumn("unit", l2_normalise("qvec")).where(F.col("unit").isNotNull() & (F.size("unit") == model.centres.shape[1]))
    q = materialize(row_number_by(q, [F.col("qid").asc_nulls_last(), F.col("qvec").asc()], out="_q"), "index-queries")
    sizes = np.zeros(len(model.centres), np.int64)
    for cell, n in table.groupBy("cell").count().collect():  # cells: at most MAX_CELLS
        sizes[cell] = n
    wave, path_hits, path_cost = max(1, WAVE_NUMBERS // model.centres.shape[1]), scratch_path(spark, "index-hits"), scratch_path(spark, "index-cost")
    id_type, qid_type = table.schema["id"].dataType, q.schema["qid"].dataType
    found = T.StructType([T.StructField("_q", T.LongType()), T.StructField("id", id_type), T.StructField("cell", T.IntegerType()), T.StructField("_est", T.DoubleType())])
    hits_schema = T.StructType([T.StructField(query_id, qid_type), T.StructField(out_id, id_type), T.StructField("rank", T.IntegerType()),
                                T.StructField("distance", T.DoubleType()), T.StructField("similarity", T.DoubleType())])
    cost_schema = T.StructType([T.StructField(query_id, qid_type), T.StructField("estimated", T.LongType()), T.StructField("scored", T.LongType()), T.StructField("rows", T.LongType())])
    n = q.count()
    for first in range(1, n + 1, wave):
        part = q.where(F.col("_q").between(first, first + wave - 1)).orderBy("_q").toArrow()
        rows, numbers = _matrix(part["unit"]), part["_q"].to_numpy()
        probed = np.zeros((len(rows), len(model.centres)), bool)
        near = np.argsort(-(rows @ model.centres.T), axis=1, kind="stable")[:, :probes]
        np.put_along_axis(probed, near, True, axis=1)
        codes = table.where(F.col("cell").isin([int(c) for c in np.flatnonzero(probed.any(axis=0))])).select("id", "code", "cell")
        rough = codes.mapInArrow(_estimates(shared, rows, numbers, probed, short), found)
        w = Window.partitionBy("_q").orderBy(F.col("_est").desc(), F.col("id").asc())
        listed = rough.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= short)
        exact = (listed.join(table.select("id", "vec", "cell"), ["cell", "id"]).join(q.select("_q", "qid", "qvec"), "_q")
                 .withColumn("dist", cosine_distance("vec", "qvec")))
        w = Window.partitionBy("_q").orderBy(F.col("dist").asc(), F.col("id").asc())
        ranked = materialize(exact.withColumn("rank", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("_q")))
                             .where(F.col("rank") <= k).select("_q", "qid", "id", "rank", "dist", "_all"), "index-ranked")
        (ranked.select(F.col("qid").alias(query_id), F.col("id").alias(out_id), "rank", F.col("dist").alias("distance"),
                       round_half_up(similarity_from_distance("dist"), digits).alias("similarity")).write.mode("append").parquet(path_hits))
        seen = spark.createDataFrame([(int(i), int(e)) for i, e in zip(numbers, probed @ sizes)], "_q long, estimated long")
        (seen.join(ranked.where("rank = 1").select("_q", "qid", "_all"), "_q")
         .select(F.col("qid").alias(query_id), "estimated", F.col("_all").alias("scored"), F.lit(int(sizes.sum())).cast("long").alias("rows"))
         .write.mode("append").parquet(path_cost))
    if not n:
        return spark.createDataFrame([], hits_schema), spark.createDataFrame([], cost_schema)
    return spark.read.schema(hits_schema).parquet(path_hits), spark.read.schema(cost_schema).parquet(path_cost)
