"""SimHash groups, line runs and repeated bytes against brute force."""

import collections
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import linededup, simhash, suffixes
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
#: Nulls, empties, ties, a repeated row, a long text, and columns that clash with names the operators use.
ODD = [(1, "Alpha beta gamma delta epsilon zeta"), (2, "ALPHA beta\tgamma delta  epsilon zeta"), (2, "another text under the same id"),
       (3, None), (4, ""), (5, " \t\n"), (None, "no id at all here"), (6, "x"), (7, "one two"), (8, "word " * 30000),
       (9, "tie tie tie"), (9, "tie tie tie"), (10, "é È ß 日本 x y")]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit("own").alias(c) for c in ("fp", "id", "block", "kept", "size", "fingerprint", "_line")])


def fingerprint(text):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = low.split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(fps, radius=2):
    """index -> set of indexes reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    out = collections.defaultdict(set)
    for i in range(len(fps)):
        out[find(i)].add(i)
    return {i: out[find(i)] for i in range(len(fps))}


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    reach = groups(fps)
    least = [min((rows[k][0] for k in reach[i] if rows[k][0] is not None), default=None) for i in range(len(rows))]
    return sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, least)), key=str)


def test_simhash_groups_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_simhash_odd_rows_and_kept_documents(spark):
    got = simhash.simhash_groups(odd(spark))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(ODD)
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    want = {tuple(sorted(g)) for g in groups([fingerprint(t) for _, t in ODD]).values()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(want)  # one of each group ...
    assert all(r in ODD for r in rows) and {1, 2, 3, 6, 7, 8, 9, 10} <= {d for d, _ in rows}  # ... that of least id
    assert sum(d == 9 for d, _ in rows) == 1 and not {4, 5} & {d for d, _ in rows}


def test_simhash_of_no_rows(spark):
    empty = odd(spark).limit(0)
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_covering_masks_lose_no_pair_and_links_are_exact(spark):
    gone = simhash.masks(2)
    assert len(gone) == 7
    for i in range(64):
        for j in range(64):
            diff = 1 << i | 1 << j
            assert any(diff & ~m == 0 for m in gone)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, 1, 3, 7, (1 << 64) - 1, (1 << 63)}
    for b in base:
        for _ in range(25):  # 0 to 4 bits away
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2)
    root = {r.node: r.root for r in components(links).collect()}
    got = collections.defaultdict(set)
    for k, s in enumerate(signed):
        got[root.get(s, s)].add(k)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups(fps).values()}


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(70)] + [(200, 200 + k) for k in range(1, 40)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{200 + k: 200 for k in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ lines


def lines_expected(rows, m):
    """rows in order of (id, occurrence); equal (id, text) rows are one document."""
    docs = sorted({(d is not None, d if d is not None else 0, xxhash.xxh64_intdigest(t or "", 42), t or "") for d, t in rows},
                  key=lambda r: (r[0], r[1], r[2] - (1 << 64) if r[2] >> 63 else r[2]))
    seen, out = {}, {}
    for k, (has, d, _, t) in enumerate(docs):
        ls = t.split("\n")
        for i in range(len(ls) - m + 1):
            seen.setdefault(tuple(ls[i:i + m]), (k, i))
    for k, (has, d, _, t) in enumerate(docs):
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - m + 1):
            if seen[tuple(ls[i:i + m])] != (k, i):
                gone.update(range(i, i + m))
        out[(d if has else None, t)] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return sorted(((d, out[(d, t or "")]) for d, t in rows), key=str)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs_equal_brute_force(spark, m):
    rng = random.Random(m)
    rows = [(k, "\n".join(rng.choice("abc" if k % 4 == 0 else "abcdefghijkl") for _ in range(rng.randint(0, 14)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "a\nb\nc\nd\ne"), (3, rows[3][1]), (3, "a\nb\nc\nd\ne"), (102, "\n" * 40), (103, "x y\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("_pos", F.lit(2))
    got = linededup.dedup_lines(df, min_lines=m)
    assert sorted(((r.doc_id, r.kept) for r in got.collect()), key=str) == lines_expected(rows, m)
    assert got.columns == ["doc_id", "text", "_pos", "removed_runs", "kept"]


@pytest.mark.parametrize("coalesce", ["true", "false"])  # one range, or groups that span ranges
def test_suffix_order_and_common_prefixes_equal_brute_force(spark, coalesce):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        check_suffix_order(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def check_suffix_order(spark):
    rng = random.Random(8)
    docs = ["\n".join(rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randint(1, 13))) for k in range(50)]
    docs += [docs[0], docs[1] + "\nq", "z\n" + docs[1], "unique\na\nb", "", "x\n" * 300]
    rows = [(d, 0, k, len(t.split("\n")), x) for d, t in enumerate(docs) for k, x in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "_id long, _th long, _pos int, _n int, _line string")
    order = linededup.suffix_order(lines)
    got = sorted(order.collect(), key=lambda r: r._at)
    count = collections.Counter(r[4] for r in rows)
    cut = [t.split("\n") for t in docs]
    assert sorted((r._id, r._pos) for r in got) == sorted((d, k) for d, _, k, _, x in rows if count[x] > 1)
    shares = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    suffix = [cut[r._id][r._pos:] for r in got]
    assert [r._lcp for r in got] == [0] + [shares(a, b) for a, b in zip(suffix, suffix[1:])]
    seen = collections.defaultdict(set)
    for d, ls in enumerate(cut):
        for k in range(len(ls)):
            for n in range(1, len(ls) - k + 1):
                if len(ls) < 100:
                    seen[tuple(ls[k:k + n])].add((d, k))
    for r in linededup.longest_repeats(order).collect():
        ls = cut[r._id]
        if len(ls) < 100:
            assert r.longest == max(n for n in range(1, len(ls) - r._pos + 1) if n == 1 or len(seen[tuple(ls[r._pos:r._pos + n])]) > 1)
        else:  # from a line on, the lines up to the last "x" occur a line earlier (the first: later) too; the empty line, elsewhere
            assert r.longest == max(1, min(299, 300 - r._pos))


def test_long_lines_and_one_line_documents_need_no_neighbour(spark):
    long, other = " ".join(f"w{k}" for k in range(6)), " ".join(f"v{k}" for k in range(5))
    rows = [(1, long), (2, long), (3, f"a\n{long}\nb"), (4, f"c\n{other}\nd"), (5, f"e\n{other}\nf"), (6, "short"), (7, "short"),
            (8, "g\nshort\nh"), (9, None), (10, ""), (11, f"a\n{long}\n{long}\nb"), (12, f"i\n{long}\nc\n{other}\nj\nk"), (13, "j\nk"), (None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {2: [0], 3: [1], 5: [], 7: [0], 10: [0], 11: [0, 1, 2, 3], 12: [1, 2, 3], 13: [0, 1]}
    # Document 11: "a" and the line as in 3, the line again, the line and "b" as in 3.
    want = sorted(((d, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(d, []))) for d, t in rows), key=str)
    got = linededup.dedup_lines(df, long_words=6).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=str) == want
    without = {r.doc_id: r.kept for r in linededup.dedup_lines(df).collect()}
    assert without[2] == long and without[7] == "short"  # two lines or more, whatever their length


def test_long_line_query_equals_its_sql(spark):
    from oracle_check import compare
    assert compare(spark, SF, ["op2_line_dedup", "op2_line_dedup_long"], verbose=False) == {"op2_line_dedup": "OK", "op2_line_dedup_long": "OK"}


def test_line_dedup_of_no_rows(spark):
    assert linededup.dedup_lines(odd(spark).limit(0)).count() == 0


# ------------------------------------------------------------------ bytes


def bytes_expected(texts, length):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize("length,period,block,ranges", [(12, 5, 50, 40), (20, 7, 400, 10**6), (40, 13, 10**6, 30)])
def test_repeated_bytes_equal_brute_force(spark, length, period, block, ranges):
    rng = random.Random(length)
    texts = []
    for k in range(70):
        word = lambda n: "".join(rng.choice("ab" if k % 9 == 0 else "abcdefg é") for _ in range(n))
        t = word(rng.randint(0, 70))
        if texts and rng.random() < 0.6:
            src = rng.choice(texts)
            at = rng.randint(0, len(src))
            t += src[at: at + rng.randint(0, 4 * length)] + word(rng.randint(0, 70))
        texts.append(t)
    texts += ["", "a" * 500, "", "short"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("own")).repartition(3)
    got = suffixes.repeated_bytes(df, length=length, period=period, block_bytes=block, range_names=ranges).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (d, _), t, gone in zip(rows, raw, bytes_expected(raw, length)):
        kept = bytes(x for x, y in zip(t, gone) if not y)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((d, len(t), hashlib.sha256(kept).hexdigest(), spans))
    have = [(r.doc_id, r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest(), len(r.spans)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    for r in got:  # the spans are what was cut
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_bytes - len(r.kept)


def passages_expected(texts, least):
    words = [t.split() for t in texts]
    holders = collections.defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            holders[tuple(w[i:i + least])].add(d)
    out = []
    for w in words:
        shared = bytearray(len(w))
        for i in range(len(w) - least + 1):
            if len(holders[tuple(w[i:i + least])]) > 1:
                shared[i:i + least] = b"\1" * least
        out.append(sum(shared))
    return out


@pytest.mark.parametrize("least,period,block,ranges", [(5, 3, 60, 40), (9, 5, 500, 10**6), (13, 7, 10**6, 30)])
def test_passages_of_words_equal_brute_force(spark, least, period, block, ranges):
    rng = random.Random(least)
    texts = []
    for k in range(80):
        some = lambda n: "".join(rng.choice("ab" if k % 9 == 0 else ["c", "dé", "e", "f", "g", "日本"]) + rng.choice(" \n\t\v") * rng.randint(1, 2) for _ in range(n))
        t = some(rng.randint(0, 20))
        if texts and rng.random() < 0.6:
            src = rng.choice(texts).split()
            at = rng.randint(0, len(src))
            t += " ".join(src[at: at + rng.randint(0, 4 * least)]) + " " + some(rng.randint(0, 20))
        if rng.random() < 0.2:
            t += t  # in the same document only
        texts.append(t)
    texts += ["", " \n", "z " * 300, "y" * 40, texts[3], texts[4] + "tail", "h " * least + "own", " ".join(["q"] * least)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = suffixes.repeated_bytes(df, length=12, period=5, block_bytes=block, range_names=ranges).collect()
    got = suffixes.repeated_bytes(df, length=12, period=5, block_bytes=block, range_names=ranges, passage_words=least, passage_period=period).collect()
    want = [(d, len((t or "").encode()), n) for (d, t), n in zip(rows, passages_expected([t or "" for _, t in rows], least))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_passage_words) for r in got), key=str) == sorted(want, key=str)
    assert any(n for *_, n in want) and not all(n for *_, n in want)
    short = lambda r: (r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))
    assert sorted(map(short, got), key=str) == sorted(map(short, plain), key=str)  # the removal is the same


def test_op3_tells_of_passages_of_over_50_words_under_400_bytes(spark, tmp):
    from tidemark.llm import queries

    rng = random.Random(3)
    word = lambda n: [f"{rng.choice('bcdfg')}{rng.randrange(10**4)}" for _ in range(n)]
    passage, shorter = word(51), word(50)
    assert len(" ".join(passage)) < 400
    rows = [(1, " ".join(word(80) + passage + word(80))), (2, " ".join(word(30)) + "\n" + "\n".join(passage) + "\n" + " ".join(word(90))),
            (3, " ".join(word(40) + shorter)), (4, " ".join(shorter + word(70))), (5, " ".join(passage[:50])),
            (6, " ".join(["same"] * 51 + word(9) + ["same"] * 51)), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_substring_dedup(spark, tmp).collect()}
    assert {d: r.n_passage_words for d, r in got.items()} == {1: 51, 2: 51, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert all(r.n_removed == 0 for r in got.values())  # under 400 bytes: told of, not removed


def test_difference_covers():
    for period in (5, 7, 13, 133, 50):
        d = suffixes.difference_cover(period).tolist()
        assert 0 in d and {(a - b) % period for a in d for b in d} == set(range(period))


def test_repeated_bytes_of_no_rows_and_of_a_very_long_text(spark):
    assert suffixes.repeated_bytes(odd(spark).limit(0)).count() == 0
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2_300_000))
    df = spark.createDataFrame([(1, long), (2, long[1_048_300:1_049_300]), (3, long[5:404])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.repeated_bytes(df).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1_048_300, 1_049_300)]  # over a stretch's end
    assert [tuple(s) for s in got[2].spans] == [(0, 1000)] and got[3].spans == []
