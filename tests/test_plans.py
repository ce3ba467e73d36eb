"""Plan-shape and scale checks: what runs where, and exactness under skew."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import concentration, news, rank, topn, upsert


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_take_ordered(spark):
    df = spark.range(1000).withColumn("code", F.col("id").cast("string")).withColumn("v", F.rand(1))
    p = plan(topn.top_n(df, "v", 20))
    assert "TakeOrderedAndProject" in p


def test_top_n_by_group_uses_window_group_limit(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("code", F.col("id")).withColumn("v", F.rand(2))
    out = topn.top_n(df, "v", 3, by=["g"])
    out.collect()
    assert "WindowGroupLimit" in plan(out) or "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_concentration_has_no_global_window(spark):
    df = spark.range(1000).withColumn("amount_num", F.rand(3) * 100)
    out = concentration.concentration(df)
    p = plan(out) + out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in p.replace("WindowGroupLimit", "")
    assert "TakeOrderedAndProject" in p


def test_global_row_number_matches_window_with_a_hot_group(spark):
    random.seed(5)
    rows = [("hot" if i % 3 == 0 else f"g{i % 17}", random.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r.id: r.rn for r in rank.row_number_by(df, order, by=["g"], partitions=7).collect()}
    w = Window.partitionBy("g").orderBy(*order)
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want
    glob = {r.id: r.rn for r in rank.row_number_by(df, order, partitions=5).collect()}
    want_g = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).collect()}
    assert glob == want_g


def test_dedupe_first_is_a_partial_aggregate_and_exact_under_skew(spark):
    rows = [("k", i, f"t{i}") for i in range(2000)] + [(f"k{i}", i, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "key string, n int, text string").repartition(8)
    out = news.dedupe_first(df, "key", ["n"])
    assert "partial_min" in plan(out)
    got = {r.key: r.text for r in out.collect()}
    assert got["k"] == "t0" and len(got) == 101


def test_upsert_is_partial_aggregate(spark):
    df = spark.createDataFrame([("a", 1, "x", 1)], "id string, b int, doc string, n int")
    p = plan(upsert.upsert_latest(None, df, "id", "b", order=["n"]))
    assert "partial_max" in p and "partial_min" in p


def test_price_filter_reaches_the_scan(spark, tmp):
    from tidemark.operators.clean import clean_quotes
    spark.range(5).selectExpr("cast(id as string) code", "'n' name", "cast(id as double) price", "1.0 change_pct", "1.0 volume", "1.0 amount").write.parquet(f"{tmp}/q")
    p = plan(clean_quotes(spark.read.parquet(f"{tmp}/q")))
    pushed = p[p.index("PushedFilters"):]
    assert "GreaterThan(price,0.0)" in pushed and clean_quotes(spark.read.parquet(f"{tmp}/q")).count() == 4


def test_snapshot_scans_the_quotes_table_not_lineitem(spark):
    from tidemark.plans.catalog import REGISTRY
    out = REGISTRY["market_snapshot"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in plan(out)  # lineitem is read once, for the table of quotes
