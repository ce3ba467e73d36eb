"""Cosine top-k retrieval (T5 exact, T6 approximate, F18).

Exact search scores every (query, document) pair - that is what "exact" means -
but never materialises the pairs as rows, and there is one plan for every size:
documents are hashed into blocks, queries into query blocks, and each (query
block, document block) cell is one cogroup task.  A cell scores tiles of
``TILE_QUERIES`` x ``TILE_DOCS`` with a NumPy product and keeps the k best of
each query, so its memory is its two blocks and one tile, whatever the numbers
of queries and documents.  Nothing passes through the driver but two row counts.
A final row_number() <= k per query (partial WindowGroupLimit) merges the
cells' lists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.vectors import cosine_distance, l2_normalise, similarity_from_distance

DEFAULT_BLOCK_ROWS = 20_000
#: One tile of scores: 1024 x 4096 doubles are 32 MB.
TILE_QUERIES, TILE_DOCS = 1024, 4096


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of length zero become NaN (no distance)."""
    v = np.stack(rows).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / norm


def _k_best(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances, ties by id."""
    keep = np.isfinite(dist)
    ids, dist = ids[keep], dist[keep]
    if len(dist) > k:
        near = dist <= np.partition(dist, k - 1)[k - 1]
        ids, dist = ids[near], dist[near]
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order]


def top_cell(docs: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best documents of each query, tile by tile."""
    if ids.dtype == object:
        ids = ids.astype(str)  # sortable for the tie-break
    out = []
    for qa in range(0, len(qids), TILE_QUERIES):
        q = _unit(queries[qa: qa + TILE_QUERIES])
        best: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], np.empty(0))] * len(q)
        for da in range(0, len(ids), TILE_DOCS):
            score = 1.0 - q @ _unit(docs[da: da + TILE_DOCS]).T
            own = ids[da: da + TILE_DOCS]
            for i in range(len(q)):
                i_ids, i_dist = _k_best(own, score[i], k)
                best[i] = _k_best(np.concatenate([best[i][0], i_ids]), np.concatenate([best[i][1], i_dist]), k)
        for qid, (b_ids, b_dist) in zip(qids[qa: qa + TILE_QUERIES], best):
            out.append(pd.DataFrame({"qid": [qid] * len(b_ids), "doc_id": b_ids, "dist": b_dist}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"qid": [], "doc_id": [], "dist": []})


def _cells(k: int):
    def fn(docs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or qs.empty:
            return pd.DataFrame({"qid": [], "doc_id": [], "dist": []})
        return top_cell(docs["v"].to_numpy(), docs["doc_id"].to_numpy(), qs["q"].to_numpy(), qs["qid"].to_numpy(), k)
    return fn


def _blocks(df: DataFrame, rows_per_block: int) -> int:
    return max(1, math.ceil(df.count() / rows_per_block))


def cosine_topk(docs: DataFrame, queries: DataFrame, k: int = 10, *,
                doc_id: str = "doc_id", doc_vec: str = "embedding",
                query_id: str = "qid", query_vec: str = "query",
                block_rows: int = DEFAULT_BLOCK_ROWS, digits: int = 6) -> DataFrame:
    """Exact k nearest documents per query by cosine distance.

    Output: qid, doc_id, rank (1..k), distance, similarity = max(0, 1-distance)
    rounded to ``digits``.  Ties are broken by doc_id.  Documents (or queries)
    with a null or zero-length vector have no distance and never appear.
    """
    qid_type = dict(queries.dtypes)[query_id]
    did_type = dict(docs.dtypes)[doc_id]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("v")).where("v is not null")
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("q")).where("q is not null")
    db, qb = _blocks(d, block_rows), _blocks(q, block_rows)
    d = d.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(db)).cast("int"))
    d = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int"))
    q = q.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(db - 1))))
    cells = (
        d.groupBy("qb", "db")
        .cogroup(q.groupBy("qb", "db"))
        .applyInPandas(_cells(k), f"qid {qid_type}, doc_id {did_type}, dist double")
    )
    return _merge(cells, k, query_id, doc_id, digits)


def _merge(cells: DataFrame, k: int, query_id: str, doc_id: str, digits: int) -> DataFrame:
    """Final top-k per query over the partial top-k lists (partial WindowGroupLimit)."""
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc(), F.col("doc_id").asc())
    top = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(
        F.col("qid").alias(query_id), F.col("doc_id").alias(doc_id), "rank",
        F.col("dist").alias("distance"),
        round_half_up(similarity_from_distance("dist"), digits).alias("similarity"),
    )


def centroids(df: DataFrame, vec: str, by: list[str] | tuple[str, ...] = (), out: str = "query") -> DataFrame:
    """Mean vector per group (a derived query set), computed by position."""
    e = df.select(*by, F.posexplode(vec).alias("pos", "x"))
    per = e.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_s"))
    return packed.select(*by, F.transform("_s", lambda s: s["m"]).alias(out))


def cosine_topk_lsh(docs: DataFrame, queries: DataFrame, k: int = 10, *,
                    doc_id: str = "doc_id", doc_vec: str = "embedding",
                    query_id: str = "qid", query_vec: str = "query",
                    bucket_length: float = 0.5, tables: int = 3, seed: int = 7,
                    digits: int = 6) -> DataFrame:
    """Approximate variant (T6): random-projection LSH on unit vectors.

    On unit vectors |a-b|^2 = 2*cosine distance, so Euclidean buckets are
    cosine buckets.  Candidates are the documents sharing a bucket with the
    query in any table (equi-join on (table, bucket)); they are scored exactly
    and cut to k.  Recall depends on ``bucket_length``/``tables``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("v"))
    d = d.withColumn("u", l2_normalise("v")).where(F.col("u").isNotNull())
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("q"))
    q = q.withColumn("u", l2_normalise("q")).where(F.col("u").isNotNull())
    lsh = BucketedRandomProjectionLSH(inputCol="uv", outputCol="h", bucketLength=bucket_length,
                                      numHashTables=tables, seed=seed)
    model = lsh.fit(d.select(array_to_vector("u").alias("uv")).limit(1))

    def keys(frame: DataFrame, idc: str) -> DataFrame:
        h = model.transform(frame.withColumn("uv", array_to_vector("u")))
        ex = h.select(idc, F.posexplode("h").alias("t", "hv"))
        return ex.select(idc, "t", vector_to_array("hv")[0].alias("b"))

    cand = keys(d, "doc_id").join(keys(q, "qid"), ["t", "b"]).select("qid", "doc_id").distinct()
    scored = (cand.join(d.select("doc_id", "v"), "doc_id").join(q.select("qid", "q"), "qid")
              .withColumn("dist", cosine_distance("v", "q")).where(F.col("dist").isNotNull()))
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc(), F.col("doc_id").asc())
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(
        F.col("qid").alias(query_id), F.col("doc_id").alias(doc_id), "rank",
        F.col("dist").alias("distance"),
        round_half_up(similarity_from_distance("dist"), digits).alias("similarity"),
    )


def recall_at_k(approx: DataFrame, exact: DataFrame, query_id: str = "qid", doc_id: str = "doc_id") -> DataFrame:
    """Share of exact hits the approximate search found, per query."""
    e = exact.select(query_id, doc_id).withColumn("_e", F.lit(1))
    a = approx.select(query_id, doc_id).withColumn("_a", F.lit(1))
    j = e.join(a, [query_id, doc_id], "left")
    return j.groupBy(query_id).agg((F.count("_a") / F.count("_e")).alias("recall"))


def cosine_topk_ivf(docs: DataFrame, queries: DataFrame, k: int = 10, *,
                    doc_id: str = "doc_id", doc_vec: str = "embedding",
                    query_id: str = "qid", query_vec: str = "query",
                    cells: int = 16, probes: int = 3, seed: int = 7,
                    sample_fraction: float | None = None, max_iter: int = 10, digits: int = 6) -> DataFrame:
    """Approximate variant (T6) with an inverted file.

    Unit vectors are clustered with pyspark.ml KMeans (distributed; fit on a
    sample when ``sample_fraction`` is given); every document is assigned to
    its cell.  Each query probes its ``probes`` nearest cells - found with the
    exact top-k above over the ``cells`` centroids, a set bounded by
    ``cells`` - and only documents of those cells are scored exactly.
    KMeans cells are roughly balanced, so no probe lands on a hot bucket the
    way a coarse LSH bucket can.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("v"))
    d = d.withColumn("u", l2_normalise("v")).where(F.col("u").isNotNull())
    train = d.select(array_to_vector("u").alias("features"))
    if sample_fraction is not None:
        train = train.sample(fraction=sample_fraction, seed=seed)
    # KMeans is iterative: keep its (sampled) training set for the fit only
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=cells, seed=seed, maxIter=max_iter, initSteps=2,
                       featuresCol="features", predictionCol="cell").fit(train)
    finally:
        train.unpersist()
    assigned = model.transform(d.withColumn("features", array_to_vector("u"))).select("doc_id", "v", "cell")
    spark = docs.sparkSession
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, embedding array<double>")
    probed = cosine_topk(centres, queries, probes, doc_id="cell", doc_vec="embedding",
                         query_id=query_id, query_vec=query_vec)
    probed = probed.select(F.col(query_id).alias("qid"), F.col("cell").cast("int").alias("cell"))
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("q"))
    cand = probed.join(q, "qid").join(assigned, "cell")
    scored = cand.withColumn("dist", cosine_distance("v", "q")).where(F.col("dist").isNotNull())
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc(), F.col("doc_id").asc())
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(
        F.col("qid").alias(query_id), F.col("doc_id").alias(doc_id), "rank",
        F.col("dist").alias("distance"),
        round_half_up(similarity_from_distance("dist"), digits).alias("similarity"),
    )
