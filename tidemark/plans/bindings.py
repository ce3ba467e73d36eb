"""Bindings of the driver's test tables to the market data model.

The test tables carry no market columns, so each market input is derived from
them with Spark (and grows with them):

* quotes  - one stock per part: price = unit price of lines shipped since
  1998-07-01, change vs. the unit price before, volume/amount = all lines.
* bars    - one daily bar per calendar day of ``events``.
* yearly  - yearly mean order value from ``orders`` (the valuation series).

Library functions take column names; only this module knows the bindings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_TYPE, exact_mean, round_half_up
from ..operators.clean import clean_quotes

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Fixed value of the binding: the day that splits "today" from "before".
QUOTE_SPLIT = "1998-07-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    recent = F.col("l_shipdate") >= F.lit(QUOTE_SPLIT).cast("timestamp_ntz")
    ext = F.col("l_extendedprice").cast(MONEY_TYPE)
    qty = F.col("l_quantity").cast(MONEY_TYPE)
    agg = li.groupBy("l_partkey").agg(
        F.sum(F.when(recent, ext)).cast("double").alias("_ext_new"),
        F.sum(F.when(recent, qty)).cast("double").alias("_qty_new"),
        F.sum(F.when(~recent, ext)).cast("double").alias("_ext_old"),
        F.sum(F.when(~recent, qty)).cast("double").alias("_qty_old"),
        F.sum(qty).cast("double").alias("volume"),
        F.sum(ext).cast("double").alias("amount"),
    )
    price = F.try_divide(F.col("_ext_new"), F.col("_qty_new"))
    prev = F.try_divide(F.col("_ext_old"), F.col("_qty_old"))
    change = F.when(prev > 0, round_half_up(F.try_divide(price - prev, prev) * F.lit(100.0), 0))
    # part is a dimension that grows with the data: a plain equi-join, the
    # aggregate side is already hash-partitioned on the key.
    joined = part.join(agg, part.p_partkey == agg.l_partkey)
    return joined.select(
        F.col("p_partkey").alias("code"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("sector"),
        price.alias("price"),
        change.alias("change_pct"),
        F.col("volume"),
        F.col("amount"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned quotes (P1) with the binding's sector column kept."""
    return clean_quotes(raw_quotes(spark, sf_dir), keep=("sector",))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return ev.groupBy(F.to_date("ts").alias("d")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
    )


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return o.groupBy(F.year("o_orderdate").cast("int").alias("yr")).agg(
        round_half_up(exact_mean("o_totalprice"), 2).alias("v")
    )


def daily_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per order date: the valuation series by day."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg(round_half_up(exact_mean("o_totalprice"), 2).alias("v"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority: the first and last order of a day by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
