"""Work that is done once: embeddings by content, answers by prompt; an account of files."""

import glob
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.embed import embed_changed, embed_with
from tidemark.operators.infer import infer_resumable, read_answers, tried
from tidemark.sources.market import file_account, read_quotes


def noted(folder):
    """Everything that a function running in tasks has noted, one file a note."""
    return sorted(open(f).read() for f in glob.glob(f"{folder}/*"))


def embedder(folder):
    os.makedirs(folder)

    def fn(texts):
        import uuid
        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return [[float(len(t)), 1.0] for t in texts]
    return lambda d, c: embed_with(d, c, fn, batch=7)


def test_a_second_run_embeds_only_what_changed(spark, tmp):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(10_000)} {'x' * rng.randrange(30)}") for i in range(300)] + [(900 + i, "the same text") for i in range(200)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = embed_changed(df, "text", f"{tmp}/store", embedder(f"{tmp}/first")).collect()
    assert sorted((r.id, tuple(r.embedding)) for r in got) == sorted((i, (float(len(t or "")), 1.0)) for i, t in rows)
    assert noted(f"{tmp}/first") == sorted({t or "" for _, t in rows})
    after = [(i, t + "!" if i in (3, 77, 201) else t) for i, t in rows]
    again = embed_changed(spark.createDataFrame(after, "id long, text string"), "text", f"{tmp}/store", embedder(f"{tmp}/second"))
    assert noted(f"{tmp}/second") == sorted(after[i][1] for i in (3, 77, 201))
    assert again.count() == len(rows) and spark.read.parquet(f"{tmp}/store").count() == len({t or "" for _, t in rows + after})
    embed_changed(df, "text", f"{tmp}/store", embedder(f"{tmp}/third"))
    assert noted(f"{tmp}/third") == []


def model(folder, poison=None, flaky=()):
    os.makedirs(folder, exist_ok=True)

    def fn(system, user):
        import uuid
        if user == poison:
            raise KeyboardInterrupt("stopped")  # no answer and no error row: the task goes down
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(user)
        if user in flaky and sum(open(x).read() == user for x in glob.glob(f"{folder}/*")) < 2:
            raise ValueError("busy")
        if user == "never":
            raise ValueError("no")
        return f"{system}/{user}"
    return fn


def test_a_run_that_fails_half_way_calls_no_prompt_twice(spark, tmp):
    prompts = [("s", f"p{i}") for i in range(120)] + [("s", "p7")] * 30 + [("s", "poison")]
    df = spark.createDataFrame(prompts, "system string, user string").repartition(6)
    with pytest.raises(Exception, match="stopped"):
        infer_resumable(df, model(f"{tmp}/calls", poison="poison"), f"{tmp}/store", concurrency=3, flush=5).count()
    first = noted(f"{tmp}/calls")
    assert first and read_answers(spark, f"{tmp}/store").count() == len(first) == len(set(first))
    out = infer_resumable(df, model(f"{tmp}/calls"), f"{tmp}/store", concurrency=3, flush=5)
    assert sorted((r.user, r.raw, r.error) for r in out.collect()) == sorted((u, f"s/{u}", None) for _, u in prompts)
    assert noted(f"{tmp}/calls") == sorted({u for _, u in prompts})  # each once, over both runs
    infer_resumable(df, model(f"{tmp}/calls"), f"{tmp}/store")
    assert noted(f"{tmp}/calls") == sorted({u for _, u in prompts})


def test_failures_are_tried_three_times_and_kept_as_rows(spark, tmp):
    df = spark.createDataFrame([("s", "a"), ("s", "busy"), ("s", "never"), (None, None)], "system string, user string")
    out = infer_resumable(df, model(f"{tmp}/calls", flaky=("busy",)), f"{tmp}/store", first_wait=0.001)
    assert {(r.user, r.raw, r.error) for r in out.collect()} == {("a", "s/a", None), ("busy", "s/busy", None), ("never", None, "ValueError: no"), (None, "/", None)}
    assert noted(f"{tmp}/calls") == ["", "a", "busy", "busy", "never", "never", "never"]
    assert {(r.raw, r.tries) for r in read_answers(spark, f"{tmp}/store").collect()} == {("s/a", 1), ("s/busy", 2), (None, 3), ("/", 1)}
    infer_resumable(df, model(f"{tmp}/more"), f"{tmp}/store", first_wait=0.001)
    assert noted(f"{tmp}/more") == ["never"] * 3  # what failed is tried again, the rest isn't
    assert infer_resumable(df.limit(0), model(f"{tmp}/more"), f"{tmp}/store").count() == 0


def test_waits_double():
    waits = []

    def fails():
        raise OSError("down")
    assert tried(fails, (), 4, 0.5, waits.append) == (None, "OSError: down", 4) and waits == [0.5, 1.0, 2.0]


def test_every_file_is_accounted_for(spark, tmp):
    line = lambda i: f"{i:06d},N,10,0,1,1,1,1,1,1,1,100,5,t\n"
    text = ",".join(schemas.QUOTE_FIELDS) + "\n" + "".join(line(i) for i in range(5000))
    whole = gzip.compress(text.encode(), mtime=0)
    files = {"20240101.csv": text.encode(), "20240102.csv.gz": whole, "20240103.csv.gz": whole[: len(whole) // 2], "20240104.csv": b"",
             "20240105.csv.gz": b"no gzip at all", "2024 0106 é.csv": text.encode()[:-7]}
    for name, data in files.items():
        with open(f"{tmp}/{name}", "wb") as f:
            f.write(data)
    quotes = read_quotes(spark, tmp, source=True)
    got = {r.file.rsplit("/", 1)[1]: (r.rows, r.status) for r in file_account(spark, tmp, quotes).collect()}
    assert len(got) == 5 and got["20240101.csv"] == got["20240102.csv.gz"] == (5000, "read")
    assert got["20240105.csv.gz"] == (0, "unread")  # the file without a byte is not listed
    assert got["20240103.csv.gz"][1] in ("cut", "unread") and got["20240103.csv.gz"][0] < 5000
    assert [s for n, s in got.items() if "0106" in n] == [(5000, "cut")]
    assert quotes.where(F.col("source_path").endswith("20240101.csv")).count() == 5000
