"""Merged partial states equal results computed from all quotes, in any order of files."""

import os
import random

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.clean import clean_quotes
from tidemark.operators.daily_state import merged_results, partial_states
from tidemark.plans.daily import daily_results
from tidemark.session import materialize
from tidemark.streaming.snapshot_refresh import refresh_daily

TABLES = ("market_summary", "top_gainers", "top_losers", "top_amount", "concentration", "sector_stats")


def quotes(spark, rng, days=2, files=5, rows=60):
    out = []
    for d in range(days):
        for f in range(files):
            for i in range(rows if f else 3 * rows):  # one hot file
                code = f"{d}{f}{i:04d}"
                change = rng.choice([None, 0.0, 10.0, round(rng.gauss(0, 3), 8), round(rng.gauss(0, 3), 2)])
                out.append((f"2024-01-0{d + 1}", f"f{f}", code, "N" + code, rng.choice([0.0, 9.5, 10.0]), change, 1.0,
                            rng.choice([None, round(rng.uniform(0, 1e6), 2), 500.0]), rng.choice([None, "bank", "tech", "oil"])))
    return spark.createDataFrame(out, "trade_date string, source_file string, code string, name string, price double, change_pct double, volume double, amount double, industry_name string")


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_merged_equals_recomputed(spark):
    raw = quotes(spark, random.Random(3))
    spot = materialize(clean_quotes(raw, keep=("trade_date", "source_file", "industry_name")), "test-spot")
    codes = raw.select("code", F.col("industry_name").alias("industry")).where("industry is not null")
    want = daily_results(raw, spark.createDataFrame([], schemas.BARS), spark.createDataFrame([], schemas.VALUATION), codes)
    got = merged_results(partial_states(spot))
    for t in TABLES:
        cols = want[t].columns
        assert rows_of(got[t], cols) == rows_of(want[t], cols), t


def test_files_in_any_order_and_packing(spark, tmp):
    rng = random.Random(8)
    bars, val = spark.createDataFrame([], schemas.BARS), spark.createDataFrame([], schemas.VALUATION)
    sectors = spark.createDataFrame([(f"{i:06d}", rng.choice(["bank", "tech"]), "2023-12-29") for i in range(200)], "code string, industry string, d string")
    sectors = sectors.select("code", "industry", F.to_date("d").alias("trade_date"))
    text = {}
    for n in range(5):
        lines = [f"{i + 40 * n:06d},N,10,0,{rng.choice([1.25, -2.5, 0, 7.123])},1,1,1,1,1,1,100,{rng.randrange(1, 10**6)},t" for i in range(40)]
        text[f"{'abcde'[n]}_2024010{1 + n % 2}.csv"] = ",".join(schemas.QUOTE_FIELDS) + "\n" + "\n".join(lines) + "\n"
    seen = []
    for turn, steps in enumerate([[sorted(text)], [[x] for x in sorted(text, reverse=True)], [sorted(text)[2:4], [sorted(text)[0]], [sorted(text)[4], sorted(text)[1]]]]):
        base = os.path.join(tmp, str(turn))
        os.makedirs(f"{base}/spot")
        for step in steps:
            for name in step:
                with open(f"{base}/spot/{name}", "w") as f:
                    f.write(text[name])
            refresh_daily(spark, f"{base}/spot", f"{base}/landed", f"{base}/results", f"{base}/ckpt", bars, val, sectors).awaitTermination()
        tables = {t: spark.read.parquet(f"{base}/results/{t}") for t in (*TABLES, "spot_clean")}
        seen.append({t: rows_of(df, sorted(set(df.columns) - {"source_file"})) for t, df in tables.items()})
        assert tables["spot_clean"].count() == 200
        assert {str(r.trade_date): r.total_count for r in tables["market_summary"].collect()} == {"2024-01-01": 120, "2024-01-02": 80}
    assert seen[0] == seen[1] == seen[2]


def test_files_of_one_name_in_two_folders(spark, tmp):
    bars, val = spark.createDataFrame([], schemas.BARS), spark.createDataFrame([], schemas.VALUATION)
    for n, folder in enumerate(("x", "y")):
        os.makedirs(f"{tmp}/spot/{folder}")
        with open(f"{tmp}/spot/{folder}/20240102.csv", "w") as f:
            f.write(",".join(schemas.QUOTE_FIELDS) + f"\n{n:06d},N,10,0,1,1,1,1,1,1,1,100,5,t\n")
        refresh_daily(spark, f"{tmp}/spot/*", f"{tmp}/landed", f"{tmp}/results", f"{tmp}/ckpt", bars, val).awaitTermination()
    assert spark.read.parquet(f"{tmp}/results/market_summary").first().total_count == 2
