"""The stored vector index: recall, upkeep against a rebuilt index, odd vectors."""

import glob

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import vector_index as vi
from tidemark.operators import vectors
from tidemark.plans.catalog import REGISTRY, row_queries

SF = "/root/testdata/sf0.01"


def table(spark, path):
    return sorted((r.id, r.cell, bytes(r.code), tuple(r.vec)) for r in spark.read.parquet(f"{path}/cells").collect())


def test_recall_and_share_of_pairs_scored(spark):
    r = REGISTRY["vector_index_recall"](spark, SF).first()
    assert r.queries == 25 and r.mean_recall >= 0.9 and r.share_scored < 0.2 and r.share_estimated <= 0.75


def test_an_updated_index_equals_a_rebuilt_one(spark, tmp):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    model = vi.build_index(e, f"{tmp}/a", cells=12)
    changed = e.where("id % 9 = 2").withColumn("embedding", F.transform("embedding", lambda x: -x)).unionByName(
        e.where("id < 30").select((F.col("id") + 10_000).alias("id"), "embedding"))
    after = e.join(changed.select("id"), "id", "left_anti").unionByName(changed)
    before = {f: open(f, "rb").read() for f in glob.glob(f"{tmp}/a/cells/*/*.parquet")}
    touched = vi.update_index(spark, f"{tmp}/a", changed)
    vi.build_index(after, f"{tmp}/b", model=model)
    assert table(spark, f"{tmp}/a") == table(spark, f"{tmp}/b")
    kept = [f for f in before if int(f.split("cell=")[1].split("/")[0]) not in touched]
    assert all(open(f, "rb").read() == before[f] for f in kept)  # other cells are left as they are
    q = row_queries(e.withColumnRenamed("id", "vec_id"))
    hits = [sorted(map(tuple, vi.search_index(spark, f"{tmp}/{x}", q, 5)[0].collect())) for x in "ab"]
    assert hits[0] == hits[1] and len(hits[0]) == 125
    assert vi.update_index(spark, f"{tmp}/a", changed) and table(spark, f"{tmp}/a") == table(spark, f"{tmp}/b")  # once more changes nothing


def test_only_the_touched_cells_are_rewritten_and_empty_ones_go(spark, tmp):
    rng = np.random.default_rng(1)
    centres = [(10.0, 0, 0, 0), (0, 10.0, 0, 0), (0, 0, 10.0, 0)]
    rows = [(i, [float(x) for x in np.array(centres[i % 3]) + rng.normal(0, 0.01, 4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    units = vi._units(df, "id", "embedding")
    own = np.array([[1.0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    model = vi.Model(own, vi.Model.fit(vi._matrix(units.select("unit").toArrow()["unit"]), 3, 1).books)
    vi.build_index(df, tmp, model=model)
    moved = df.where("id % 3 = 0").withColumn("embedding", F.lit([0.0, 9.0, 0.1, 0.0]))
    assert vi.update_index(spark, tmp, moved) == [0, 1]
    assert {r.cell: r.n for r in spark.read.parquet(f"{tmp}/cells").groupBy("cell").agg(F.count("*").alias("n")).collect()} == {1: 20, 2: 10}
    assert not glob.glob(f"{tmp}/cells/cell=0/*.parquet")


def test_odd_vectors_and_hot_copies(spark, tmp):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.4])]
    rows += [(100 + i, [0.6, 0.8]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    vi.build_index(df, tmp)
    assert spark.read.parquet(f"{tmp}/cells").count() == 202
    q = spark.createDataFrame([(1, [0.6, 0.8]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "qid int, query array<double>")
    hits, cost = vi.search_index(spark, tmp, q, 4, probes=99, short=500)
    want = vectors.cosine_topk(spark.read.parquet(f"{tmp}/cells"), q, 4, doc_id="id", doc_vec="vec")
    assert sorted((r.qid, r["rank"], r.doc_id) for r in hits.collect()) == sorted((r.qid, r["rank"], r.id) for r in want.collect())
    assert {(r.estimated, r.rows) for r in cost.collect()} == {(202, 202)}
    assert vi.build_index(df.limit(0), f"{tmp}/none") is None
