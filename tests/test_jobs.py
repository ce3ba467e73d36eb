"""Daily job, news normalisation caps, per-date refresh stream."""

import os

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import news
from tidemark.plans.daily import run_daily
from tidemark.streaming.snapshot_refresh import refresh_daily


def write_quotes(d, day, rows):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{day}.csv"), "w") as f:
        f.write(",".join(schemas.QUOTE_FIELDS) + "\n")
        for code, chg, amt in rows:
            f.write(f"{code},N{code},10,0,{chg},1,1,1,1,1,1,100,{amt},t\n")


def test_run_daily_writes_nine_tables_per_date(spark, tmp):
    raw = os.path.join(tmp, "raw")
    write_quotes(os.path.join(raw, "a_spot"), "20240102", [("000001", 1.5, 100), ("000002", -2, 50)])
    write_quotes(os.path.join(raw, "a_spot"), "20240103", [("000001", 0, 10)])
    os.makedirs(os.path.join(raw, "industry"))
    with open(os.path.join(raw, "industry", "20240102.csv"), "w") as f:
        f.write("code,name,industry\n000001,A,bank\n000002,B,tech\n")
    out = os.path.join(tmp, "out")
    paths = run_daily(spark, raw, out)
    assert len(paths) == 11  # the nine results, how many codes found no sector, and the account of files
    assert {(r.rows, r.status) for r in spark.read.parquet(paths["file_account"]).collect()} == {(2, "read"), (1, "read")}
    assert {(str(r.trade_date), r.unmatched, r.quotes) for r in spark.read.parquet(paths["unmatched_codes"]).collect()} == {("2024-01-02", 0, 2), ("2024-01-03", 0, 1)}
    ms = {str(r.trade_date): r for r in spark.read.parquet(paths["market_summary"]).collect()}
    assert ms["2024-01-02"].total_count == 2 and ms["2024-01-03"].flat_count == 1
    sec = spark.read.parquet(paths["sector_stats"]).where("trade_date = '2024-01-02'").count()
    assert sec == 2
    assert spark.read.parquet(paths["index_stats"]).count() == 1  # typed, from an empty bar table


def test_normalise_news_caps_and_synthesised_urls(spark):
    rows = [(i, f"summary {i}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, summary string, url string")
    m = news.SourceMapping(source="cx", title=F.col("summary"), content=F.col("summary"),
                           url=F.col("url"), url_prefix="cx_", cap=50, order=["pos"])
    out = news.normalise_news(df, m, "20240101").collect()
    assert len(out) == 50
    urls = sorted(r.url for r in out)
    assert "cx_20240101_0" in urls and "cx_20240101_49" in urls and "cx_20240101_50" not in urls


def test_union_skips_failed_sources(spark):
    a = spark.createDataFrame([("t", "u")], "title string, url string")
    assert news.union_sources([a, None, a]).count() == 2
    assert news.union_sources([None]) is None


def test_refresh_daily_rewrites_only_new_dates(spark, tmp):
    src = os.path.join(tmp, "spot")
    write_quotes(src, "20240102", [("000001", 1, 100)])
    bars = spark.createDataFrame([], schemas.BARS)
    val = spark.createDataFrame([], schemas.VALUATION)
    landed, results, ckpt = (os.path.join(tmp, x) for x in ("landed", "results", "ckpt"))
    refresh_daily(spark, src, landed, results, ckpt, bars, val).awaitTermination()
    write_quotes(src, "20240103", [("000001", -1, 100), ("000002", 2, 100)])
    refresh_daily(spark, src, landed, results, ckpt, bars, val).awaitTermination()
    ms = {str(r.trade_date): r.total_count for r in spark.read.parquet(f"{results}/market_summary").collect()}
    assert ms == {"2024-01-02": 1, "2024-01-03": 2}


def test_normalise_news_synthesised_urls_without_cap(spark):
    rows = [(i, f"s{i}", None) for i in range(30)]
    df = spark.createDataFrame(rows, "pos int, summary string, url string")
    m = news.SourceMapping(source="cctv", title=F.col("summary"), url=F.col("url"), url_prefix="cctv_", order=["pos"])
    out = {r.title: r.url for r in news.normalise_news(df, m, "20240101").collect()}
    assert len(out) == 30 and out["s0"] == "cctv_20240101_0" and out["s29"] == "cctv_20240101_29"


def test_refresh_daily_keeps_every_file_of_a_date(spark, tmp):
    src = os.path.join(tmp, "spot")
    bars, val = spark.createDataFrame([], schemas.BARS), spark.createDataFrame([], schemas.VALUATION)
    landed, results, ckpt = (os.path.join(tmp, x) for x in ("landed", "results", "ckpt"))

    def run():
        refresh_daily(spark, src, landed, results, ckpt, bars, val).awaitTermination()
        return {str(r.trade_date): r.total_count for r in spark.read.parquet(f"{results}/market_summary").collect()}

    write_quotes(src, "a_20240102", [("000001", 1, 100), ("000002", 1, 100)])
    assert run() == {"2024-01-02": 2}
    write_quotes(src, "b_20240102", [("000003", 1, 100)])
    write_quotes(src, "b_99999999", [("000004", 1, 100)])  # no date: set aside, the stream goes on
    assert run() == {"2024-01-02": 3}
    assert spark.read.parquet(f"{landed}-undated").count() == 1
    for name in ("pe_by_year", "index_stats"):
        assert os.path.isdir(f"{results}/{name}")


def test_news_days_in_one_batch_or_two(spark, tmp):
    from test_stream import drop, run

    art = lambda t: {"title": t, "content": "content long enough " + t, "url": "u1", "source": "s", "crawl_date": None}
    got = []
    for steps in (1, 2):
        base, src = os.path.join(tmp, f"base{steps}"), os.path.join(tmp, f"news{steps}")
        os.makedirs(src)
        drop(src, "20240101", [art("OLD")])
        if steps == 2:
            run(spark, src, base)
        drop(src, "20240102", [art("NEW"), art("later in the day")])
        run(spark, src, base)
        got.append([(r.document.split("\n")[0], r.batch_date) for r in spark.read.parquet(f"{base}/kb").collect()])
    assert got[0] == got[1] == [("NEW", "20240102")]


def test_upsert_table_loses_nothing(spark, tmp):
    import glob

    import pytest
    from tidemark.operators.upsert import upsert_table

    path = os.path.join(tmp, "kb")
    rows = lambda ids, v: spark.createDataFrame([(i, f"{v}-{i}", v) for i in ids], "id long, text string, ver int")
    table = lambda: {r.id: r.text for r in spark.read.parquet(path).collect()}
    upsert_table(spark, path, rows(range(20), 1), "id", "ver", buckets=4)
    upsert_table(spark, path, rows(range(20), 2), "id", "ver", buckets=4)
    upsert_table(spark, path, rows([3], 3), "id", "ver", buckets=4)  # nothing of an earlier staging comes back
    assert table() == {**{i: f"2-{i}" for i in range(20)}, 3: "3-3"}
    broken = sorted(glob.glob(f"{path}/bucket=*"))[0] + "/part-broken.parquet"
    with open(broken, "wb") as f:
        f.write(b"not parquet")
    for b in range(4):
        with pytest.raises(Exception):
            upsert_table(spark, path, rows(range(100, 140), 4), "id", "ver", buckets=4)
            break
    os.unlink(broken)
    assert table() == {**{i: f"2-{i}" for i in range(20)}, 3: "3-3"}
