"""Connected components over an edge table, by alternating star contraction.

Each round is two joins and two aggregations over the edges (large-star, then
small-star); no component is ever gathered in a task.  A hub's edges meet its
one minimum in a join of two tables, whose hot partitions AQE splits.
Every round is written to a table in the shared folder, so that a lost executor
only costs the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._common import shuffle_partitions


def _large_star(e: DataFrame, files: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least-neighbours", files)
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, files: int) -> DataFrame:
    # Edges point from the larger to the smaller end (a > b).
    low = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours", files)
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def components(edges: DataFrame, max_rounds: int = 60, edges_a_file: int = 200_000) -> DataFrame:
    """Edges (a, b) of comparable keys -> (node, root), root being the least
    node of the component, for every node that has an edge to another one.
    Null ends and self loops are left out; no edges give no rows.

    Edges are few beside the rows they come from, so the tables of the rounds
    have a file for each ``edges_a_file`` of them (the first, not counted yet,
    an eighth of the shuffle partitions).  ``max_rounds`` guards against a
    defect, it is not a limit: passing it raises.
    """
    spark = edges.sparkSession
    most = shuffle_partitions(spark)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges", most // 8)
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        files = min(most, mark[0] // edges_a_file + 1)
        e = materialize(_large_star(e, files), "edges", files)
        e = materialize(_small_star(e, files), "edges", files)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
