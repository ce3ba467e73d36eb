"""Language ID, quality ranking, decontamination, mixing, records, token
counts, fingerprints and the pipeline."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, langid, merkle, mixing, quality, queries, records, tokencount
from tidemark.session import scratch_path

SF = "/root/testdata/sf0.001"
ODD = [(1, "Alpha beta gamma delta epsilon zeta", "b"), (2, None, None), (2, "", "b"), (3, " \t\n", "a"), (None, "no id at all here", "a"),
       (4, "123 456 !!", None), (5, "long " * 60000, "b"), (6, "tie tie", "a"), (6, "tie tie", "a"), (7, "é È ß 日本́ x", "c")]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    return df.select("*", *[F.lit("own").alias(c) for c in ("score", "label", "matches", "edits", "tree", "size", "copies", "rate", "weight", "ids")])


# ------------------------------------------------------------------ language


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_language_id(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(both) == 1000 and both.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98
    assert both.rejected.mean() < 0.01  # clean documents stay


def test_language_of_odd_rows_and_without_labels(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), rows_per_label=40)
    assert model.labels == ["de", "en", "es", "fr"]
    got = langid.identify(odd(spark), model)
    assert got.columns == [c for c in odd(spark).columns if c != "score"] + ["lang_pred", "score", "rejected"]
    rows = got.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        blank = not r.text or not any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == blank and (not blank or (r.score == 0 and r.rejected)) and 0 <= r.score <= 1
    none = langid.train(odd(spark).limit(0))
    assert none.labels == [] and {r.lang_pred for r in langid.identify(odd(spark), none).collect()} == {"und"}
    assert langid.keep_identified(odd(spark).limit(0), model).count() == 0


def test_histogram_is_the_same_in_pieces(monkeypatch):
    text = "Ünïcode and plain words " * 50
    whole = langid.histogram(text, 512)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.histogram(text, 512) == whole).all() and whole.sum() > 0
    assert langid.histogram("", 512).sum() == 1  # the two boundary spaces


# ------------------------------------------------------------------ quality


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_ranking(spark, sf).toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_cut_is_of_all_rows_not_of_the_sample(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):  # 40 of label 0, which overlap with the others
        word = lambda: "".join(rng.choice("abcdef" if rng.random() < (0.6 if k % 10 else 0.4) else "123456") for _ in range(5))
        rows.append((k, " ".join(word() for _ in range(12)), int(k % 10 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for bound in (40, 1000):  # a sample of as many of either label, and all rows
        model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), rows_per_label=bound)
        assert sum(r.score < model.cut for r in quality.score_quality(df, model).collect()) == 40


def test_quality_of_odd_rows_and_without_a_label(spark):
    labels = spark.createDataFrame([(1, 1), (7, 1), (4, 0), (4, 1), (None, 0), (2, None), (6, 0)], "doc_id long, quality int")
    model = quality.train(odd(spark), labels)
    rows = quality.score_quality(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    flat = quality.train(odd(spark), labels.where("quality = 1"))
    assert {round(r.score, 9) for r in quality.score_quality(odd(spark), flat).collect()} == {quality.CUT}
    assert quality.score_quality(odd(spark).limit(0), model).count() == 0
    assert np.isfinite(quality.features(None)).all() and np.isfinite(quality.features("日" * 5000)).all()


def test_bradley_terry_orders_by_strength_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    better = x @ np.array([2, -1, 0, 0, 0.5]) > -1
    model = quality.fit_pairs(x, better)
    s = model.score(x)
    assert ((s >= model.cut) == better).mean() > 0.97
    assert abs((s < model.cut).mean() - (~better).mean()) < 0.01
    assert (np.argsort(s, kind="stable") == np.argsort(model.strength(x), kind="stable")).all()


# ------------------------------------------------------------------ decontamination


def brute_tiles(a, b, width):
    """Greedy string tiling by trying every pair of places."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= width and (best is None or n > best[0]):
                    best = (n, j, i)
        if best is None:
            return tiles
        n, j, i = best
        tiles.append((i, j, n))
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        width = rng.choice([2, 3, 5])
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        if b and rng.random() < 0.7:
            k = rng.randint(0, len(b))
            a = a + b[k:] + ["e"] + b[:k]
        index = decontam.PassageIndex([(0, " ".join(b))], width)
        want = brute_tiles(a, b, width)
        covered = sum(n for _, _, n in want) / len(b) if b else 0
        got = index.match(" ".join(a), 1e-9)
        assert got == ([(0, covered, len(want))] if want else [])


def test_contaminated_documents(spark):
    words = [f"w{i}" for i in range(40)]
    tests = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "too short"), (4, " ".join(words)), (None, "p q r s t u v w")], "item_id long, text string")
    moved = " ".join(words[20:] + ["and"] + words[:20])
    docs = [(1, "Before, " + " ".join(words).upper() + "! after"), (2, moved), (3, " ".join(words[:20])), (4, None), (5, ""), (6, "p q r s t u v w"),
            (None, moved), (7, " ".join(words[:3]) * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit("own")).withColumn("coverage", F.lit(1))
    for block in (2_000_000, 30):  # one block, and many
        got = decontam.contaminated(df, tests, block_tokens=block).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(
            [(1, 1), (1, 4), (2, 1), (2, 4), (None, 1), (None, 4), (6, None)], key=str)
        assert {r.tiles for r in got if r.doc_id == 2} == {2}
    assert sorted(r.doc_id for r in decontam.keep_clean(df, tests).collect()) == [3, 4, 5, 7]
    assert decontam.contaminated(df.limit(0), tests).count() == 0 and decontam.contaminated(df, tests.limit(0)).count() == 0


def test_planted_passages_are_found(spark):
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    planted = {(d.doc_id, b.item_id) for b in items for d in docs if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()}
    assert planted and planted <= got and len(got) <= len(planted) * 1.1


def test_one_pass_scores_as_training_and_scoring_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, may_learn=queries.op7_may_learn())
    got, same = quality.rank_quality(docs, labels, may_learn=queries.op7_may_learn())
    assert same.anchor == model.anchor and got.columns == ["doc_id", "score"]
    # Brute force: the fitted weights, row by row, outside Spark.
    want = {r.doc_id: float(model.score(quality.features(r.text)[None, :])[0]) for r in docs.collect()}
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(want, abs=1e-9)
    flat, _ = quality.rank_quality(odd(spark), labels.where("quality = 1"))
    assert [r.score for r in flat.collect()] == pytest.approx([0.3] * len(ODD))
    assert quality.rank_quality(docs.limit(0), labels)[0].count() == 0


# ------------------------------------------------------------------ mixing


def test_mix_follows_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_source_mix(spark, sf).toPandas()
    src = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas()
    per = got.merge(src, on="doc_id").groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.source_size).all() and abs(per.target.sum() - per["size"].sum()) < 1
    assert (got.taken <= 3 * got["size"]).all()
    part = (per.target / per.source_size) % 1
    squares = got.merge(src, on="doc_id").assign(sq=lambda d: d["size"] ** 2.0).groupby("source").sq.sum()
    noise = (squares * part * (1 - part)) ** 0.5  # of independent copies
    assert (abs(per.taken - per.target) <= 4 * noise + 1).all() and abs(per.taken.sum() / per.target.sum() - 1) < 0.05


def test_targets_of_capped_sources(spark):
    sizes = [("a", 1), ("b", 1000), ("c", 10), ("d", 0), (None, 500)]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert {k: r.weight for k, r in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    want = {"a": 3.0, "c": 30.0, "d": 0.0, "b": 739.0, None: 739.0}
    assert {k: r.target for k, r in got.items()} == pytest.approx(want)
    assert all(r.target <= 3 * r.source_size for r in got.values())


def test_mix_of_odd_rows_and_reruns(spark):
    plan = mixing.mix_plan(odd(spark))
    rows = sorted(map(tuple, plan.collect()), key=str)
    assert len(rows) == len(ODD) and rows == sorted(map(tuple, mixing.mix_plan(odd(spark).repartition(3)).collect()), key=str)
    taken = collections.Counter()
    for r in plan.collect():
        taken[r.doc_id, r["size"]] += r.copies
    out = mixing.mix(odd(spark))
    assert out.columns == odd(spark).columns
    got = collections.Counter((r.doc_id, len((r.text or "").encode().split())) for r in out.collect())
    assert got == +taken
    assert mixing.mix_plan(odd(spark).limit(0)).count() == 0 and mixing.mix(odd(spark).limit(0)).count() == 0


# ------------------------------------------------------------------ records


def test_encoder_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(records, "CACHE_WORDS", 50)
    coder = records.WordEncoder(queries.word_bpe_path(), 1)
    assert coder.short
    rng = random.Random(9)
    bits = ["a", "B", "é", "É", "É", " ", " ", "\x1c", "\x85", "İ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "1", "!", "̈", "日本", "　",
            "\n", "Hello", "ſ", "x.y,", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids = np.frombuffer(coder.encode(t), coder.kind).tolist()
        assert ids == coder.tok.encode(t, add_special_tokens=False).ids + [1]


def test_records_round_trip(spark):
    path = queries.word_bpe_path()
    manifest = records.write_records(odd(spark), scratch_path(spark, "test-records"), path, shards=3)
    got = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    coder = records.WordEncoder(path, 1)
    want = sorted(((d, coder.tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]  # ascending ids, null first
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(d), tuple(i)) for d, i in want)
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    digest = {r.start: r.ids_crc32 for r in records.read_records(manifest, digest=True).collect()}
    assert digest == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    row = manifest.first()
    shard = records.ShardReader(row["data"], row["index"])
    assert len(shard) == row["records"]
    for k in reversed(range(len(shard))):  # any order
        shard.record(k)
    empty = records.write_records(odd(spark).limit(0), scratch_path(spark, "test-records"), path)
    assert records.read_records(empty).count() == 0


def test_rows_of_one_id_are_spread_over_shards(spark):
    ids = [7] * 300 + [None] * 300 + list(range(100, 400))
    df = spark.createDataFrame([(d, f"text number {k}") for k, d in enumerate(ids)], "doc_id long, text string").repartition(5)
    manifest = records.write_records(df, scratch_path(spark, "test-records"), queries.word_bpe_path(), shards=9)
    assert max(r.records for r in manifest.collect()) < 200
    got = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [7] * 300 + list(range(100, 400))
    assert len({tuple(r.ids) for r in got}) == 900


def test_a_changed_byte_is_noticed():
    body = records.pack_body(-5, np.array([1, 2, 70], "<u2").tobytes(), False)
    raw = records.frame(body)
    assert records.unframe(raw) == (body, len(raw))
    doc, ids = records.unpack_body(body)
    assert doc == -5 and ids.tolist() == [1, 2, 70]
    assert records.unpack_body(records.pack_body(None, b"", False))[0] is None
    for k in range(len(raw)):
        bad = bytearray(raw)
        bad[k] ^= 4
        with pytest.raises(records.CorruptRecord):
            records.unframe(bytes(bad))
    for k in range(len(raw)):
        with pytest.raises(records.CorruptRecord):
            records.unframe(raw[:k])


# ------------------------------------------------------------------ token counts


RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_edited_counts_equal_a_full_encoding():
    counter = tokencount.piece_counter(RANKS, PATTERN)
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'r", "'", "1", "é", "。", "!", "hello world ", "   x"]
    for k in range(800):
        tree = tokencount.CountTree("".join(rng.choice(bits) for _ in range(rng.randint(0, 3000 if k % 40 == 0 else 150))), counter)
        assert tree.total == len(counter.encoding.encode_ordinary(tree.text))
        for _ in range(4):
            at, cut, text = rng.randint(-1, len(tree.text) + 2), rng.choice([0, 1, 5, 100]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            a = min(max(at, 0), len(tree.text))
            want = tree.text[:a] + text + tree.text[a + cut:]
            tree.edit(at, cut, text)
            assert tree.text == want and tree.chars[1] == len(want) and tree.total == len(counter.encoding.encode_ordinary(want))


def test_a_small_edit_of_a_long_text_encodes_little():
    counter = tokencount.piece_counter(RANKS, PATTERN)
    tree = tokencount.CountTree("some words and more. " * 20000, counter)
    assert tree.total == len(counter.encoding.encode_ordinary(tree.text))
    assert tree.edit(200_000, 3, "xyz") < 10 and tree.total == len(counter.encoding.encode_ordinary(tree.text))


def test_token_counts_of_odd_rows(spark):
    edits = spark.createDataFrame([(1, 2, 0, 5, "B"), (1, 1, 3, None, None), (5, 1, 100, 7, " x "), (6, 1, 99, 1, "end"), (None, 1, 0, 1, "?")],
                                  "doc_id long, seq int, at long, del long, ins string")
    docs = tokencount.attach_edits(odd(spark), edits)
    got = tokencount.count_edits(docs, RANKS, PATTERN).collect()
    enc = tokencount.piece_counter(RANKS, PATTERN).encoding
    assert len(got) == len(ODD)
    for r in got:
        text = r.text or ""
        want = {1: "B beta gamma delta epsilon zeta", 5: text[:100] + " x " + text[107:], 6: text + "end"}.get(r.doc_id, text)
        assert r.counts.edited == want and r.counts.n_tokens == len(enc.encode_ordinary(text)) and r.counts.n_edited == len(enc.encode_ordinary(want))
    assert tokencount.count_edits(docs.limit(0), RANKS, PATTERN).count() == 0


def test_token_count_query(spark):
    enc = tokencount.piece_counter(RANKS, PATTERN).encoding
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_token_counts(spark, SF).collect():
        d = docs[r.doc_id]
        t, n = d.text, len(d.text)
        t = t[:n // 4] + " " + d.text[:60] + t[n // 4:]
        t = t[:n // 2] + d.source + "\n" + d.lang + t[n // 2 + 25:]
        t = t[:3 * n // 4] + t[3 * n // 4 + 200:]
        assert (r.n_tokens, r.n_edited) == (len(enc.encode_ordinary(d.text)), len(enc.encode_ordinary(t)))
        assert r.edited_sha256 == hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------------ fingerprints


def edits_expected(rows):
    """(id, edited) of rows with distinct ids, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (d, t) in enumerate(order):
        nxt, m = order[(k + 1) % len(order)][1], len(t) // 3
        out[d] = t[:len(t) - m] + nxt[:m]
    return out


@pytest.mark.parametrize("n", [1, 2, 40])
def test_edited_texts(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(-10**9, 10**9), "".join(rng.choice("ab c\né日") for _ in range(rng.randint(0, 90)))) for _ in range(n - 1)]
    rows = list(dict(rows).items()) + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tree", F.lit("own"))
    got = {r.doc_id: r for r in merkle.with_edit(df).collect()}
    want = edits_expected([(d, t or "") for d, t in rows])
    assert {d: r.edited for d, r in got.items()} == want


def test_fingerprint_tells_equal_from_unequal_and_locates_edits(spark):
    base = "one two three four five six seven\n" * 3 + "a line of its own\n" + "tail " * 30
    texts = ["", base, base, base.replace("own", "new"), base + "\n", base + " ", "x"]
    rows = merkle.with_tree(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i long, text string"), "text", "tree").collect()
    root = {r.i: r.tree.fp.split("|")[0] for r in rows}
    assert root[1] == root[2] and root[99] == root[0] and len({root[k] for k in (0, 1, 3, 4, 5, 6)}) == 6
    para = {r.i: [p.split("=")[0] for s in r.tree.fp.split("|")[1:] for p in s.split(":")[1].split(";")] for r in rows}
    assert [a == b for a, b in zip(para[1], para[3])] == [True, True, True, False, True]


def test_likeness_is_that_of_leaves_with_repeats(spark):
    rng = random.Random(3)
    words = ["a", "bb", "", "c"]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 9)))
    rows = [(text(), text()) for _ in range(150)] + [("tail " * 4000, "tail " * 2000 + "head " * 2000), ("", "x"), (None, "")]
    df = merkle.with_tree(merkle.with_tree(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    leaves = lambda t: collections.Counter(" ".join(p.split(" ")[k:k + 5]) for p in (t or "").split("\n") for k in range(0, len(p.split(" ")), 5))
    for r in df.withColumn("like", merkle.likeness(F.col("x"), F.col("y"))).collect():
        a, b = leaves(r.a), leaves(r.b)
        assert r.like == pytest.approx(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
        assert len(r.x.leaves) == len(set(r.x.leaves)) == sum(a.values())


def test_rows_of_one_id_are_spread_over_ranges(spark):
    ids = [7] * 300 + [None] * 300 + list(range(300)) + [250] * 100
    tie = lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (h >> 63 << 64)
    rows = [(d, f"one two three {k}") for k, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    src = df.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_tie"))
    assert max(r["count"] for r in merkle._in_ranges(src, 32).groupBy("_shard").count().collect()) < 100
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    want = {t: t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3] for k, (_, t) in enumerate(order)}
    # The first third of all texts is alike; the next tree is what tells the rows apart.
    got = merkle.with_edit(df).select("text", "edited", "tree.fp", F.col("next_tree.fp").alias("next")).collect()
    assert {r.text: r.edited for r in got} == want and len(got) == len(rows)
    fp = {r.text: r.fp for r in got}
    assert {r.text: r.next for r in got} == {t: fp[order[(k + 1) % len(order)][1]] for k, (_, t) in enumerate(order)}


def test_digest_of_odd_rows(spark):
    got = merkle.edit_digest(odd(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    ties = [r for r in got if r.doc_id == 6]
    assert len({r.fingerprint for r in ties}) == 1 and max(r.near_next for r in ties) == 1.0
    assert merkle.edit_digest(odd(spark).limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept, frames = [], docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        frames = stage(spark, frames, SF)
        assert frames.columns == docs.columns
        kept.append(frames.toPandas())
    n = docs.count()
    assert 0.97 * n <= len(kept[0]) <= n
    fps = {r.doc_id: r.component_id for r in queries.op1_simhash_dedup(spark, SF).collect()}
    assert set(kept[1].doc_id) <= set(kept[0].doc_id) and len(kept[1]) == len({fps[d] for d in kept[0].doc_id})
    items = [b.text for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d.doc_id for d in kept[1].itertuples() if any(t in d.text for t in items)}
    assert not leaks & set(kept[2].doc_id) and set(kept[1].doc_id) - set(kept[2].doc_id) >= leaks
    times = kept[3].doc_id.value_counts()
    assert times.max() <= 3 and set(times.index) <= set(kept[2].doc_id)
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert got.doc_id.value_counts().sort_index().equals(times.sort_index().astype(got.doc_id.value_counts().dtype))
    assert got.doc_id.is_monotonic_increasing and (got.start.to_numpy() == np.cumsum([0, *got.n_tokens])[:-1]).all()
    assert isinstance(got, pd.DataFrame)


def test_pipeline_stages_on_odd_rows(spark):
    frames = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        frames = stage(spark, frames, SF)
    assert frames.count() >= 0
    empty = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


# ------------------------------------------------------------------ oracles


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    from oracle_check import compare

    assert compare(spark, SF, [name], verbose=False)[name] == "OK"
