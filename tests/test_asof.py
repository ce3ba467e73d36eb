"""As-of join, position among earlier rows and trailing windows against brute force."""

import datetime as dt
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans.daily import run_daily


def latest(dim, key, t):
    rows = [(s, v) for k, s, v in dim if None not in (k, s, key, t) and k == key and s <= t]
    return max(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))[1] if rows else None


def test_asof_join_with_a_hot_key_ties_and_nulls(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "c", None])
    when = lambda: rng.choice([None, *range(40)])
    facts = [(i, key(), when()) for i in range(1500)] + [(9000 + i, "hot", 20) for i in range(700)]
    dim = [(key(), when(), rng.choice(["x", "y", "z", None])) for _ in range(120)]
    f = spark.createDataFrame(facts, "id long, code string, t int").repartition(6)
    d = spark.createDataFrame(dim, "code string, since int, industry string")
    got = {r.id: r.industry for r in asof.asof_join(f, d, "code", "t", "since", ["industry"]).collect()}
    assert got == {i: latest(dim, k, t) for i, k, t in facts}
    assert asof.asof_join(f, d.limit(0), "code", "t", "since", ["industry"]).where("industry is not null").count() == 0
    assert asof.asof_join(f.limit(0), d, "code", "t", "since", ["industry"]).count() == 0


def test_a_quote_gets_the_industry_of_its_own_date(spark, tmp):
    from test_jobs import write_quotes

    raw = os.path.join(tmp, "raw")
    for day in ("20240101", "20240601", "20240603"):
        write_quotes(os.path.join(raw, "a_spot"), day, [("sh000001", 1, 100)])
    os.makedirs(os.path.join(raw, "industry"))
    for day, industry in (("20231231", "old"), ("20240602", "new")):
        with open(os.path.join(raw, "industry", f"{day}.csv"), "w") as f:
            f.write(f"code,name,industry\n000001,A,{industry}\n")
    paths = run_daily(spark, raw, os.path.join(tmp, "out"))
    got = {str(r.trade_date): r.industry_name for r in spark.read.parquet(paths["sector_stats"]).collect()}
    assert got == {"2024-01-01": "old", "2024-06-01": "old", "2024-06-03": "new"}


def test_dominated_counts_strictly():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 257):
        x, y = rng.integers(0, 12, n), rng.integers(0, 9, n)
        assert list(asof.dominated(x, y)) == [int(((x < a) & (y < b)).sum()) for a, b in zip(x, y)]


@pytest.mark.parametrize("block", [None, 1, 7, 40])
def test_earlier_below_with_hot_values_and_dates(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["g", "g", "h", None]), rng.choice([None, 5, 5, *range(30)]), rng.choice([None, float("nan"), 2.0, 2.0, 2.0, *map(float, range(20))])) for i in range(600)]
    rows += [(1000, "alone", 1, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, t int, v double").repartition(4)
    fine = lambda r: r[2] is not None and r[3] is not None and r[3] == r[3]
    for by in ([], ["g"]):
        got = {r.id: (r.n_earlier, r.n_below) for r in asof.earlier_below(df, "t", "v", by=by, block_rows=block).collect()}
        for i, g, t, v in rows:
            if not fine((i, g, t, v)):
                assert got[i] == (None, None)
                continue
            before = [r for r in rows if fine(r) and (not by or r[1] == g) and r[2] < t]
            assert got[i] == (len(before), sum(r[3] < v for r in before))


def test_position_of_no_rows_and_of_the_first(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 5.5)], "t int, v double")
    assert {r.t: r.percentile for r in asof.position_asof(df, "t", "v").collect()} == {1: None, 2: 100.0, 3: 50.0}
    assert asof.position_asof(df.limit(0), "t", "v").collect() == []


def test_trailing_windows_over_many_spans(spark):
    rng = random.Random(9)
    start = dt.date(2019, 12, 20)
    rows = [(g, start + dt.timedelta(days=rng.randrange(400)), rng.choice([0.0, 10.0, 11.0]), round(rng.uniform(9, 12), 2)) for g in "ab" for _ in range(250)]
    rows += [("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, d date, open double, close double")
    got = asof.trailing_stats(df, "d", days=30, by=["g"], span_days=37).collect()
    assert len(got) == 500
    for r in got:
        own = [x for x in rows if x[0] == r.g and x[1] is not None and dt.timedelta(0) <= r.d - x[1] < dt.timedelta(days=30)]
        ret = [(c - o) / o * 100 for _, _, o, c in own if o]
        assert (r.n_bars, r.close_min, r.close_max) == (len(own), min(x[3] for x in own), max(x[3] for x in own))
        assert abs(r.close_avg - statistics.mean(x[3] for x in own)) < 0.006
        assert (r.volatility is None) == (len(ret) < 2) and (len(ret) < 2 or abs(r.volatility - statistics.stdev(ret)) < 0.006)
    with pytest.raises(ValueError):
        asof.trailing_stats(df, "d", days=30, span_days=20)


def test_plans_have_no_single_partition(spark):
    df = spark.range(100).select(F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("open"), F.lit(3.0).alias("close"))
    p = asof.trailing_stats(df.withColumn("t", F.date_from_unix_date(F.col("t").cast("int"))), "t")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in p
