"""Exact inner-product top-k by Fagin's threshold algorithm.

The vectors are cut, partition by partition and without a shuffle, into blocks
of at most ``block_rows``; a block holds, beside its vectors, one list of its
rows for each dimension, sorted by that component.  A query walks the lists of
its non-zero coordinates from the favourable end (the greatest components for a
positive coordinate, the least for a negative one), a few rows deeper at a time,
and scores the rows that it meets for the first time.  The components at the
frontier give the threshold: the most that any row not yet met can score.  The
walk ends when the threshold is below the k-th best score so far (not when it
equals it, as a row with a smaller id may tie), or when every row has been met.

Queries go to the tasks in waves of a bounded number of coordinates; each wave
is one job over the stored blocks and is final when it ends, so its results are
appended to a table and a lost executor costs its tasks only.  What is shuffled
is at most k rows of a (query, block).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import row_number_by
from ..session import materialize, scratch_path

#: Coordinates of one wave of queries: 8 MB as doubles.
WAVE_NUMBERS = 1 << 20
BLOCK_ROWS = 8192  # a place in a block fits two bytes
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vec: Column, scale: float) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no
    part: null, or holding a null or a component that is not finite."""
    scaled = F.transform(vec.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fine = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return F.when(fine, scaled)


def _floors(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(flat).reshape(-1, dims)


def _index(block_rows: int):
    """(id, vector) rows -> blocks of vectors of one length with their sorted lists."""
    def block(ids: pa.Array, x: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        near = pc.sort_indices(ids, null_placement="at_end")  # so that a place orders ties
        ids, x = ids.take(near), x[near.to_numpy()]
        small = not x.size or np.abs(x).max() < 2.0**24
        lists = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
        cell = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.shape[1]], pa.int32()), pa.array([small]),
                pa.array([x.astype(np.float32 if small else np.float64).tobytes()], pa.binary()), pa.array([lists.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cell, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        schema = None
        for b in batches:
            schema = schema or pa.schema([("ids", pa.list_(b.column(0).type)), ("dims", pa.int32()), ("small", pa.bool_()),
                                          ("x", pa.binary()), ("lists", pa.binary())])
            lengths = pc.list_value_length(b.column(1))
            for dims in pc.unique(lengths).to_pylist():
                part = b.filter(pc.equal(lengths, dims))
                for at in range(0, part.num_rows, block_rows):
                    cut = part.slice(at, block_rows)
                    rows = held.setdefault(dims, [])
                    rows.append((cut.column(0), _floors(cut.column(1), dims) if dims else np.empty((cut.num_rows, 0))))
                    while sum(len(i) for i, _ in rows) >= block_rows:
                        ids, x = pa.concat_arrays([i for i, _ in rows]), np.concatenate([v for _, v in rows])
                        yield block(ids.slice(0, block_rows), x[:block_rows], schema)
                        rows[:] = [(ids.slice(block_rows), x[block_rows:])] if len(ids) > block_rows else []
        for rows in held.values():
            if rows:
                yield block(pa.concat_arrays([i for i, _ in rows]), np.concatenate([v for _, v in rows]), schema)

    return run


def index_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored blocks: ids (ascending, nulls last), dims, and the vectors and
    their sorted lists as packed numbers.  Vectors of unlike lengths, which have
    no inner product, go to blocks of their own."""
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("a block has 1 to 65536 rows")
    rows = vectors.select(F.col(id_col).alias("_id"), whole(F.col(vec_col), scale).alias("_v")).where("_v is not null")
    out = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["_id"].dataType)), T.StructField("dims", T.IntegerType()),
                        T.StructField("small", T.BooleanType()), T.StructField("x", T.BinaryType()), T.StructField("lists", T.BinaryType())])
    return materialize(rows.mapInArrow(_index(block_rows), out), "threshold-blocks")


def depths(rows: int) -> list[int]:
    """The depths at which the threshold is looked at: 8, 12, 18, ..., the end."""
    out, at = [], 8
    while at < rows:
        out.append(at)
        at += at // 2
    return [*out, rows]


def walk(x: np.ndarray, lists: np.ndarray, at: list[int], q: np.ndarray, bound: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, rows met) of the k best rows of one block for a query:
    greatest score first, ties by place.  ``bound``: the threshold at each depth."""
    rows = len(x)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    if not len(up) + len(down):  # every row scores 0
        places = np.setdiff1d(np.arange(min(rows, k + len(own))), own)[:k]
        return places, np.zeros(len(places), q.dtype), rows
    done = np.zeros(rows, bool)
    done[own] = True
    seen = done.copy()
    places, scores, before = np.empty(0, np.int64), np.empty(0, x.dtype), 0
    for depth, most in zip(at, bound):
        seen[lists[up, rows - depth: rows - before]] = True
        seen[lists[down, before: depth]] = True
        new = np.flatnonzero(seen & ~done)
        done |= seen
        before = depth
        if len(new):
            got = (x @ q)[new] if 4 * len(new) > rows else x[new] @ q
            if got.dtype == object:
                got = np.array([max(LEAST, min(MOST, int(s))) for s in got], object)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, got])
            if len(scores) > k:
                keep = scores >= np.sort(scores)[-k]
                places, scores = places[keep], scores[keep]
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
        if len(scores) == k and most < scores[-1] or done.all():
            break
    return places, scores, int(done.sum())


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """The cheapest numbers in which every sum of products is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else object


def _whole_numbers(a: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in a.ravel()], object).reshape(a.shape)


def _search(wave: dict[int, tuple[np.ndarray, np.ndarray, pa.Array]], k: int):
    """Blocks -> (_q, _id, _score).  ``wave``: for each length of vectors the
    numbers of its queries, their vectors and their ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                dims = b.column("dims")[n].as_py()
                if dims not in wave:
                    continue
                numbers, queries, query_ids = wave[dims]
                ids = b.column("ids")[n].values
                x = np.frombuffer(b.column("x")[n].as_buffer(), np.float32 if b.column("small")[n].as_py() else np.float64).reshape(len(ids), dims)
                lists = np.frombuffer(b.column("lists")[n].as_buffer(), np.uint16).reshape(dims, len(ids))
                kind = _exact(x, queries)
                x, q = (_whole_numbers(x), _whole_numbers(queries)) if kind is object else (x.astype(kind), queries.astype(kind))
                at = depths(len(ids))
                # The components at each depth, from either end, and the thresholds they give.
                least = np.stack([x[lists[:, d - 1], np.arange(dims)] for d in at], axis=1)
                most = np.stack([x[lists[:, len(ids) - d], np.arange(dims)] for d in at], axis=1)
                bounds = np.maximum(q, 0) @ most + np.minimum(q, 0) @ least
                same = pc.index_in(ids, value_set=pc.unique(query_ids)).to_numpy(zero_copy_only=False)
                names = pc.index_in(query_ids, value_set=pc.unique(query_ids)).to_numpy(zero_copy_only=False)
                own = {}
                for place in np.flatnonzero(~np.isnan(same.astype(np.float64))):
                    own.setdefault(int(same[place]), []).append(place)
                out_q, out_at, out_s = [], [], []
                for i in range(len(numbers)):
                    mine = np.array(own.get(int(names[i]), []), np.int64)
                    places, scores, _ = walk(x, lists, at, q[i], bounds[i], mine, k)
                    out_q += [numbers[i]] * len(places)
                    out_at.append(places)
                    out_s += [int(s) for s in scores]
                places = np.concatenate(out_at) if out_at else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), ids.take(pa.array(places, pa.int64())), pa.array(out_s, pa.int64())],
                                                 names=["_q", "_id", "_score"])
    return run


def topk_inner(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
               scale: float = 256.0, block_rows: int = BLOCK_ROWS, wave_numbers: int = WAVE_NUMBERS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the greatest inner product for each row
    of ``queries`` (same columns): query_id, rank (from 1), id_col, score.

    Products are those of floor(scale * x), in whole numbers; ties go to the
    smaller id (null last).  A query's own row takes no part: rows that share a
    query's id count as its own.  Fewer candidates give fewer rows.  Vectors
    that are null or hold a null or non-finite component take no part on either
    side, nor does a query without an id; vectors of unlike lengths don't meet.
    Queries equal in id and vector are one; others that share an id are queries
    of their own.  A score beyond 64 bits counts as the end of that range.  Empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, id_type), T.StructField("score", T.LongType())])
    asked = queries.select(F.col(id_col).alias("_id"), whole(F.col(vec_col), scale).alias("_v")).where("_id is not null and _v is not null").distinct()
    asked = materialize(row_number_by(asked, [F.col("_id").asc(), F.col("_v").asc()], out="_q"), "threshold-queries")
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    blocks = index_vectors(vectors, id_col, vec_col, scale, block_rows)
    found = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_id", id_type), T.StructField("_score", T.LongType())])
    path, size = scratch_path(spark, "threshold-hits"), max(1, wave_numbers // max(1, longest))
    for first in range(1, n + 1, size):
        rows = asked.where(F.col("_q").between(first, first + size - 1)).orderBy("_q").toArrow()
        lengths, wave = pc.list_value_length(rows["_v"]), {}
        for dims in pc.unique(lengths).to_pylist():
            part = rows.filter(pc.equal(lengths, dims)).combine_chunks()
            wave[dims] = (part["_q"].to_pylist(), _floors(part["_v"].combine_chunks(), dims) if dims else np.empty((part.num_rows, 0)),
                          part["_id"].combine_chunks().cast(blocks_id(blocks)))
        hits = blocks.mapInArrow(_search(wave, k), found)
        w = Window.partitionBy("_q").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last())
        best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ids = asked.select(F.col("_q").alias("_n"), F.col("_id").alias("query_id"))
        (best.join(ids, F.col("_q") == F.col("_n")).select("query_id", "rank", F.col("_id").alias(id_col), F.col("_score").alias("score"))
         .write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)


def blocks_id(blocks: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(blocks.schema["ids"].dataType.elementType)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
