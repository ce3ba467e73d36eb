"""Upserts whose answer doesn't hang on bucket counts, equal versions or packing."""

import itertools
import json
import os

from tidemark.operators.upsert import upsert_latest, upsert_table
from tidemark.streaming.news_ingest import ingest_news


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, ver int")


def rows_of(df):
    return sorted((r.id, r.text, r.ver) for r in df.collect())


def test_a_changed_bucket_count_deals_the_table_anew(spark, tmp):
    path = os.path.join(tmp, "kb")
    upsert_table(spark, path, frame(spark, [(i, "old", 1) for i in range(100)]), "id", "ver", buckets=16)
    upsert_table(spark, path, frame(spark, [(i, "new", 2) for i in range(0, 100, 3)]), "id", "ver", buckets=7)
    want = [(i, "old" if i % 3 else "new", 1 if i % 3 else 2) for i in range(100)]
    assert rows_of(spark.read.parquet(path)) == want
    assert sorted(os.listdir(path))[:1] == ["_SUCCESS"] or all(int(d.split("=")[1]) < 7 for d in os.listdir(path) if d.startswith("bucket="))
    assert upsert_table(spark, path, frame(spark, [(5, "x", 9)]), "id", "ver", buckets=7) and len(rows_of(spark.read.parquet(path))) == 100


def test_a_table_without_a_note_is_checked(spark, tmp):
    import shutil

    path = os.path.join(tmp, "kb")
    upsert_table(spark, path, frame(spark, [(i, "old", 1) for i in range(50)]), "id", "ver", buckets=16)
    shutil.move(os.path.join(path, "_layout"), os.path.join(tmp, "note"))
    upsert_table(spark, path, frame(spark, [(i, "new", 2) for i in range(50)]), "id", "ver", buckets=5)
    assert rows_of(spark.read.parquet(path)) == [(i, "new", 2) for i in range(50)]


def test_updates_replace_rows_of_equal_or_null_version(spark):
    base = frame(spark, [(1, "zzz", 1), (2, "zzz", 5), (3, "zzz", None), (4, "zzz", 9), (5, "zzz", 2)])
    new = frame(spark, [(1, "abc", 1), (2, "abc", 4), (3, "abc", 1), (4, "abc", None), (5, "abc", None), (5, "b", 1), (6, "n", None)])
    assert rows_of(upsert_latest(base, new, "id", "ver")) == [(1, "abc", 1), (2, "zzz", 5), (3, "abc", 1), (4, "abc", None), (5, "zzz", 2), (6, "n", None)]
    assert rows_of(upsert_latest(base, new.limit(0), "id", "ver")) == rows_of(base)
    assert rows_of(upsert_latest(None, new, "id", "ver"))[4] == (5, "b", 1)


def article(url, text, **more):
    return {"title": text, "content": more.pop("content", "content long enough " + text), "url": url, "source": "s", "crawl_date": None, **more}


DROPS = {
    "a_20240101": [article("u1", "first"), article("u2", "x", content="")],  # u2's first article of the day is too short
    "b_20240101": [article("u1", "second"), article("u2", "long"), article("u3", "only")],
    "c_20240102": [article("u3", "y", content="")],  # shows nothing: the day before stays
    "d_20240102": [article("u1", "next day"), article("u3", "later, not first")],
}


def ingest(spark, base, steps, files_per_batch):
    src = os.path.join(base, "news")
    os.makedirs(src)
    for step in steps:
        for name in step:
            with open(os.path.join(src, f"{name}.jsonl"), "w") as f:
                f.writelines(json.dumps(a) + "\n" for a in DROPS[name])
        ingest_news(spark, src, f"{base}/kb", f"{base}/bad", f"{base}/ckpt", buckets=3, files_per_batch=files_per_batch).awaitTermination()
    return sorted((r.metadata.url, r.document.split("\n")[0], r.batch_date) for r in spark.read.parquet(f"{base}/kb").collect())


def test_any_packing_of_the_files_gives_the_same_table(spark, tmp):
    names = sorted(DROPS)
    want = [("u1", "next day", "20240102"), ("u3", "only", "20240101")]
    packings = [([names], 1000), ([names], 1), ([names[::-1][:2], names[:2]], 1), ([[n] for n in names[::-1]], 1000), ([[names[1]], [names[3]], [names[0], names[2]]], 1000)]
    for n, (steps, per) in enumerate(packings):
        assert ingest(spark, os.path.join(tmp, str(n)), steps, per) == want, (steps, per)


def test_an_earlier_file_that_comes_late_takes_its_place(spark, tmp):
    assert ingest(spark, tmp, [["b_20240101"]], 1000) == [("u1", "second", "20240101"), ("u2", "long", "20240101"), ("u3", "only", "20240101")]
    base = os.path.join(tmp, "again")
    for steps in itertools.permutations(["a_20240101", "b_20240101"]):
        got = ingest(spark, os.path.join(base, steps[0]), [[s] for s in steps], 1000)
        assert got == [("u1", "first", "20240101"), ("u3", "only", "20240101")]
