"""Ranked search, exact vector top-k and the dataset manifest against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, manifest, threshold
from tidemark.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
CLASHES = ("rank", "score", "_id", "_n", "_t", "_q", "_v", "_g", "_at", "_w", "_leaf", "item_id", "query_id", "root")


def clash(df, own=()):
    return df.select(*df.columns, *[F.lit("own").alias(c) for c in CLASHES if c not in (*df.columns, *own)])


# ---------------------------------------------------------------- op 11


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranked(docs, items, k):
    """(item id, rank, doc id, score) by scoring every pair."""
    bags = [(i, t, collections.Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, words = len(bags), sum(len(t) for _, t, _ in bags)
    df = collections.Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for at, (doc, t, c) in enumerate(bags):
            m = 50 + (50 * len(t) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if x in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, at))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


ODD_DOCS = [(1, "Alpha beta, ALPHA gamma"), (2, "alpha beta; alpha gamma"), (2, "beta beta beta"), (3, None), (4, ""), (5, " ,.\n\t-"), (None, "alpha"),
            (None, "delta éÉ 日本"), (6, "é É"), (7, "x" * 300_000), (8, "alpha " * 30_000 + "beta"), (9, "tie tie"), (9, "tie tie"), (10, "tie tie"), (11, "a1_b2 A1_B2")]
ODD_ITEMS = [(1, "alpha BETA"), (1, "alpha BETA"), (1, "delta"), (2, None), (3, ""), (4, "--"), (None, "tie"), (5, "É"), (6, "x" * 300_000), (7, "absent"), (8, "b2 a1")]


@pytest.mark.parametrize("k,chunk", [(50, 2048), (2, 3), (1, 1)])
def test_search_odd_rows(spark, k, chunk):
    docs = clash(spark.createDataFrame(ODD_DOCS, "doc_id long, text string"))
    items = clash(spark.createDataFrame(ODD_ITEMS, "item_id long, text string"))
    out = lexical.rank_documents(docs, items, k=k, chunk_docs=chunk)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == ranked(ODD_DOCS, ODD_ITEMS, k)


def test_search_random_texts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4)
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(int(rng.paretovariate(0.8)) % 400 + 1))) for i in range(900)]
    docs += [(2000 + i, docs[i % 40][1]) for i in range(300)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(50)]
    a = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                               spark.createDataFrame(items, "item_id long, text string"), k=7, chunk_docs=100)
    assert sorted(map(tuple, a.collect()), key=str) == ranked(docs, items, 7)


def test_search_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD_DOCS, "doc_id long, text string"), spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []
    assert lexical.rank_documents(docs.where("doc_id = 3"), items).collect() == []


def test_descent_prunes_and_keeps_all():
    """Fewer pairs are scored than there are, and none of the k best is lost."""
    rng = np.random.default_rng(3)
    n_docs, n_terms = 2048, 400
    topic = rng.integers(0, 8, n_docs)
    doc, term = np.nonzero(rng.random((n_docs, n_terms)) < np.where(np.arange(n_terms) // 50 == topic[:, None], 0.3, 0.005))
    f = rng.integers(1, 4, len(doc))
    n = np.bincount(doc, f, n_docs).astype(np.int64) + 1
    items = [rng.choice(np.arange(50 * (i % 8), 50 * (i % 8) + 50), 12, replace=False) for i in range(64)]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * np.bincount(term, minlength=n_terms) + 1)))
    search = lexical.Search(lexical.ItemTree(items, weights), n_terms, n_docs, int(n.sum()), 10, np.zeros(64, np.int64))
    got = {i: sorted(s)[::-1] for i, _, s in search.chunk(n, doc, term, f)}
    dense = np.zeros((n_docs, n_terms))
    dense[doc, term] = lexical.shares(n[doc], f, n_docs, int(n.sum()))
    for i, t in enumerate(items):
        assert got[i] == sorted((dense[:, t] @ weights[t]).astype(int))[::-1][:10]
    assert search.scored < 0.5 * search.pairs


# ---------------------------------------------------------------- op 12


def top(vectors, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * 256) for x in v)
    whole = lambda v: [math.floor(x * 256) for x in v]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}:
        scores = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole(qv), whole(v))))), i is None, i or 0) for i, v in vectors if ok(v) and len(v) == len(qv) and i != q]
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


INF, NAN = float("inf"), float("nan")
ODD_VECTORS = [(0, [1.0, -0.5]), (1, [1.0, -0.5]), (1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [NAN, 1.0]), (5, [INF, 0.0]), (None, [2.0, 2.0]),
               (6, []), (7, []), (8, [1.0]), (9, [0.0, 0.0]), (10, [1e30, -1e30]), (11, [3.0, -7.001]), (12, [-0.001, 0.001]), (13, [1e307, 1.0])]


@pytest.mark.parametrize("k,block,wave", [(5, 8192, 1 << 20), (2, 2, 3), (1, 1, 1)])
def test_vectors_odd_rows(spark, k, block, wave):
    v = clash(spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<double>"))
    out = threshold.topk_inner(v, v, k=k, block_rows=block, wave_numbers=wave)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == top(ODD_VECTORS, ODD_VECTORS, k)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e18])
def test_vectors_random(spark, scale):
    """Numbers that need 32-bit floats, doubles, whole numbers, and more than 64 bits."""
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in np.round(rng.standard_normal(6), 2) * scale]) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = threshold.topk_inner(v, v.where("vec_id % 20 = 0"), block_rows=64)
    assert sorted(map(tuple, out.collect()), key=str) == top(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_vectors_empty_tables(spark):
    v = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<double>")
    assert threshold.topk_inner(v.limit(0), v).collect() == []
    assert threshold.topk_inner(v, v.limit(0)).collect() == []


def test_walk_stops_before_all_rows_are_met():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((4096, 3)))
    lists = np.argsort(x, axis=0, kind="stable").T
    q = np.array([300.0, -20.0, 0.0])
    at = threshold.depths(len(x))
    most = np.stack([x[lists[:, len(x) - d], np.arange(3)] for d in at], axis=1)
    least = np.stack([x[lists[:, d - 1], np.arange(3)] for d in at], axis=1)
    places, scores, met = threshold.walk(x, lists, at, q, np.maximum(q, 0) @ most + np.minimum(q, 0) @ least, np.array([], int), 5)
    every = x @ q
    assert list(scores) == sorted(every)[::-1][:5] and all(every[places] == scores) and met < 1000


# ---------------------------------------------------------------- op 13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    """(siblings before, after) on each level."""
    steps = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        steps.append((nodes[first:at], nodes[at + 1:first + 3]))
        at //= 3
    return steps


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of documents (doc_id, source, lang, n_chars, text)."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for n, s in enumerate(sources):
        for at, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[n], at) + path(top, n)
            f = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                f = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            for before, after in steps:
                f = h(*before, f, *after)
            out.append((r[0], own, trees[n][-1][0], top[-1][0], h(*[d for b, a in steps for d in (*b, *a)]), f, f == top[-1][0]))
    return sorted(out, key=str)


def run_manifest(spark, rows, levels, tmp_path):
    df = clash(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), own=())
    (df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet"))
    if levels is None:
        return sorted(map(tuple, REGISTRY["op13_dataset_manifest"](spark, str(tmp_path)).collect()), key=str)
    changed = [F.translate("text", "\n", "") if c == "text" else c for c in manifest.COLUMNS]
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, manifest.digest_of(changed))
    got = manifest.manifest(spark.read.parquet(f"{tmp_path}/documents.parquet"), levels=levels, extra={"_tampered": claim})
    return sorted(map(tuple, manifest.verify(got.withColumn("_claimed", F.coalesce("_tampered", "_leaf")), "_claimed").collect()), key=str)


ODD_ROWS = [(1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", None, None, None), (None, "a", "en", 0, ""), (2, None, None, None, None), (3, None, "é", 1, "é\n\n"),
            (4, "b", "en", 9, "word\n" * 40_000), (5, "é", "en", 1, "-"), (6, "", "en", 1, "1:-"), (None, None, None, None, None), (7, "日", "en", -1, "\n"), (8, "a", "en", 3, "x\ny")]


@pytest.mark.parametrize("levels", [None, 1, 2])
def test_manifest_odd_rows(spark, tmp_path, levels):
    assert run_manifest(spark, ODD_ROWS, levels, tmp_path) == expected(ODD_ROWS)


@pytest.mark.parametrize("levels,n", [(1, 40), (2, 100), (1, 1), (2, 9), (2, 10), (8, 82)])
def test_manifest_tiers(spark, tmp_path, levels, n):
    """A hot source and others, over several tiers of small blocks."""
    rng = random.Random(n)
    rows = [(i, "hot" if i % 3 else f"s{rng.randrange(14):02d}", "en", i, "line\n" * rng.randrange(3) + str(i)) for i in range(n)]
    assert run_manifest(spark, rows, levels, tmp_path) == expected(rows)


def test_manifest_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = REGISTRY["op13_dataset_manifest"](spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_change_breaks_the_proof(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = manifest.verify(manifest.manifest(docs, levels=2))
    assert rows.where("not verified or folded_root <> root").count() == 0 and rows.count() == docs.count()
    other = manifest.manifest(docs, levels=2).withColumn("_claim", F.unhex(F.sha2(F.col("_leaf"), 256)))
    assert manifest.verify(other, "_claim").where("verified").count() == 0


def test_appended_witnesses_fold_to_the_root():
    for n in range(1, 60):
        state = manifest.Witnesses()
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        for d in leaves:
            state.append(d)
        root, _ = state.close(None)
        assert root.hex() == levels_of([d.hex() for d in leaves])[-1][0]
        assert all(manifest.fold(d, i, n, bytes(w)) == (root, len(w)) for i, (d, w) in enumerate(zip(leaves, state.partial)))
