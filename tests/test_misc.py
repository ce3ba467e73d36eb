"""Smaller operators: year, status filter, counts, totals, user functions, sinks."""

import os

from pyspark.sql import functions as F

from tidemark.operators import boards, clean, embed, gather, infer, rank, render, rollups
from tidemark.sinks import writers
from tidemark.sources.market import peek


def test_p3_year_from_text_and_dates(spark):
    df = spark.createDataFrame([("2023-05-01",), ("bad",)], "date string")
    assert [r.year for r in clean.with_year(df).collect()] == [2023, None]
    d2 = df.where("date <> 'bad'").select(F.to_date("date").alias("date"))
    assert clean.with_year(d2).collect()[0].year == 2023


def test_p11_a9_w2(spark):
    df = spark.createDataFrame([("a", "ok", 1.0), ("b", "range", 2.0), ("a", "ok", 3.0)], "g string, status string, amount double")
    assert gather.successful(df).count() == 2
    assert {r.g: r.n for r in rollups.count_rows(df, by=["g"]).collect()} == {"a": 2, "b": 1}
    assert {r.total for r in rank.with_total(df, "amount").collect()} == {6.0}
    assert {(r.g, r.total) for r in rank.with_total(df, "amount", by=["g"]).collect()} == {("a", 4.0), ("b", 2.0)}


def test_c7_user_function_batches_in_order(spark):
    calls = []

    def fn(texts):
        calls.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(45)], "id int, text string").coalesce(1)
    out = embed.embed_with(df, "text", fn, batch=20).collect()
    assert all(r.embedding[0] == float(r.id) for r in out)
    empty = spark.createDataFrame([], "id int, text string")
    assert embed.embed_with(empty, "text", fn).count() == 0


def test_c8_inference_records_errors(spark):
    def fn(system, user):
        if "boom" in user:
            raise RuntimeError("fail")
        return f"{system}:{user}"

    df = spark.createDataFrame([("s", "u1"), ("s", "boom")], "system string, user string")
    rows = {r.user: r for r in infer.infer(df, fn).collect()}
    assert rows["u1"].raw == "s:u1" and rows["u1"].error is None
    assert rows["boom"].raw is None and "fail" in rows["boom"].error


def test_c14_answer_rows_for_gathered_results(spark):
    df = spark.createDataFrame([("d", "偏多", 42.0, 0.8)], "d string, s string, p double, c double")
    g = df.select("d", F.struct(F.col("s").alias("sentiment"), F.struct(F.col("p").alias("percentile")).alias("pe_valuation"),
                                F.col("c").alias("confidence")).alias("macro"),
                  F.lit(None).cast("struct<capital_direction: string, confidence: double>").alias("fund_flow"))
    rows = {r.analyst: r.line for r in render.answer_rows(g, ["d"], ["macro", "fund_flow"]).collect()}
    assert rows["macro"] == "| 🏛️ 宏观分析师 | 偏多，PE分位42.0% | 80% |"
    assert rows["fund_flow"] == "| 💰 资金面分析师 | ❌ 分析失败 | - |"


def test_u3_board_cap_and_failed_boards(spark):
    df = spark.createDataFrame([("b1", 1, [("1", "a")]), ("b2", 2, None), ("b3", 3, [("3", "c")])],
                               "industry string, pos int, constituents array<struct<code: string, name: string>>")
    assert boards.flatten_boards(df).count() == 2
    assert boards.flatten_boards(df, max_boards=2, order="pos").count() == 1


def test_k1_k6_k7_sinks_and_peek(spark, tmp):
    tables = {"pe_by_year": spark.createDataFrame([(2022, 2.0), (2021, 1.0)], "year int, avg_pe_val double")}
    writers.write_results(tables, os.path.join(tmp, "res"))
    assert [r.year for r in spark.read.parquet(os.path.join(tmp, "res", "pe_by_year")).collect()] == [2021, 2022]
    rep = spark.createDataFrame([("2024-01-02", "s")], "report_date string, summary string")
    md = spark.createDataFrame([("2024-01-02", "# md")], "report_date string, markdown string")
    writers.write_reports(rep, md, os.path.join(tmp, "rep"))
    assert spark.read.text(os.path.join(tmp, "rep", "markdown")).collect()[0].value == "# md"
    cards = spark.createDataFrame([("20240102", 0.8)], "date string, overall_score double")
    writers.write_eval_cards(cards, os.path.join(tmp, "cards"))
    assert spark.read.json(os.path.join(tmp, "cards")).count() == 1
    assert peek(spark.range(10), 3).count() == 3
