"""Stages on tables whose columns clash with every private name, and samples that stay bounded."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, quality, simhash

NAMES = ("_row", "_fp", "_lang", "_score", "_rejected", "_mix_source", "_mix_rate", "_mix_turn", "_mix_copy", "_matches", "_id", "_text", "_u", "_rn",
         "_source", "fp", "id", "size", "source_size", "target", "rate", "turn", "_MATCHES_")
TEXT = ["the quick brown fox jumps over the lazy dog again and again", "der schnelle braune fuchs springt", "", None, "the quick brown fox jumps over the lazy dog again and again"]


def docs(spark):
    rows = [(i, TEXT[i % 5], "en" if i % 5 in (0, 4) else "de", f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def stages(spark):
    items = spark.createDataFrame([(1, "zig zag zog zug zeg zyg")], "item_id long, text string")
    model = langid.LanguageModel([], __import__("numpy").zeros((1 << 12, 0), "float32"), __import__("numpy").zeros(0, "float32"))
    return {"keep_one": simhash.keep_one, "mix": mixing.mix, "keep_clean": lambda d: decontam.keep_clean(d, items),
            "keep_identified": lambda d: langid.keep_identified(d, model)}


@pytest.mark.parametrize("name", ["keep_one", "mix", "keep_clean", "keep_identified"])
def test_callers_columns_come_through(spark, name):
    df = docs(spark)
    out = stages(spark)[name](df)
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[c] == f"{c}:{r.doc_id}" for c in NAMES)


def test_samples_are_rows_with_a_hard_bound(spark):
    for same in (1, 7, 12345):
        rows = spark.range(3000).select(F.lit(same).cast("long").alias("_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("_label"),
                                        F.concat(F.lit("text "), F.col("id").cast("string")).alias("_text"))
        got = {r._label: r.n for r in langid.sample_per_label(rows, "_id", "_label", 20).groupBy("_label").agg(F.count("*").alias("n")).collect()}
        assert got == {"a": 20, "b": 20}
        model = langid.train(rows, id_col="_id", text_col="_text", label_col="_label", rows_per_label=20)
        assert model.labels == ["a", "b"]
        labels = rows.select("_id", F.lit(1).alias("quality")).limit(1)
        assert quality.train(rows, labels, id_col="_id", text_col="_text", rows_per_label=30).anchor == 0.0  # one label only


def test_of_two_thousand_labels_the_largest_are_learned(spark):
    rows = spark.range(2000).select(F.explode(F.sequence(F.lit(0), F.when(F.col("id") < 3, 40).otherwise(0).cast("int"))).alias("k"), F.col("id").alias("label"))
    rows = rows.select((F.col("label") * 1000 + F.col("k")).alias("_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("_label"), F.lit("some text").alias("_text"))
    got = langid.sample_per_label(rows, "_id", "_label", 10).groupBy("_label").count().collect()
    assert len(got) == langid.MAX_LABELS and {r._label for r in got if r["count"] == 10} == {"l0", "l1", "l2"}


def test_few_rows_are_ranked(spark):
    """Only rows below the hash limit of their label reach the ranking."""
    rows = spark.range(50_000).select(F.col("id").alias("_id"), F.lit("a").alias("_label"))
    plans = []
    original, langid.materialize = langid.materialize, lambda df, name: plans.append(df) or df
    try:
        langid.sample_per_label(rows, "_id", "_label", 100)
    finally:
        langid.materialize = original
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "_most" in plan[plan.index("Join"):].split("\n")[0]  # the limit is part of the join below the window
