"""Incremental news ingest: a rerun adds nothing, a new drop adds only its rows."""

import json
import os

from tidemark.operators.embed import hash_embed
from tidemark.streaming.news_ingest import ingest_news


def drop(d, day, items, bad=False):
    with open(os.path.join(d, f"{day}.jsonl"), "w") as f:
        for it in items:
            f.write(json.dumps(it, ensure_ascii=False) + "\n")
        if bad:
            f.write("{broken\n\n")


def run(spark, src, base):
    q = ingest_news(spark, src, f"{base}/kb", f"{base}/bad", f"{base}/ckpt",
                    embed=lambda d: hash_embed(d, "document", dims=32), buckets=4)
    q.awaitTermination()


def test_news_ingest_replay(spark, tmp):
    src = os.path.join(tmp, "news")
    os.makedirs(src)
    art = lambda u, t: {"title": t, "content": "content long enough " + t, "url": u, "source": "s", "crawl_date": None}
    drop(src, "20240101", [art("u1", "a"), art("u2", "b"), art("u1", "dup")], bad=True)
    run(spark, src, tmp)
    kb = spark.read.parquet(f"{tmp}/kb")
    assert kb.count() == 2
    assert spark.read.parquet(f"{tmp}/bad").count() == 1
    run(spark, src, tmp)  # nothing new
    assert spark.read.parquet(f"{tmp}/kb").count() == 2
    drop(src, "20240102", [art("u2", "new"), art("u3", "c")])
    run(spark, src, tmp)
    rows = {r.metadata.url: r for r in spark.read.parquet(f"{tmp}/kb").collect()}
    assert set(rows) == {"u1", "u2", "u3"}
    assert "new" in rows["u2"].document and rows["u2"].batch_date == "20240102"
    assert rows["u1"].document.startswith("a\n")
