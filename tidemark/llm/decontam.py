"""Benchmark decontamination by greedy string tiling.

The test passages are the stated query set.  Documents are read once for each
block of passages: a block is bounded in tokens (``block_tokens``), goes to the
tasks as one index, and every document meets it inside its own task, so there
is no shuffle and no join of documents, and a passage that a third of all
documents hold costs each of them just its own tiling.

For a document and a passage that share a seed (a run of ``min_tile`` equal
tokens, found by Karp-Rabin hashes of the token numbers and confirmed on the
tokens), greedy string tiling marks the longest match of unmarked tokens, again
and again, until none of ``min_tile`` tokens is left.  The share of passage
tokens marked is its coverage: moved or cut passages are still covered by
several tiles, and a run repeated in the document counts once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_names, rows_in

_TOKEN = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _TOKEN.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of every run of ``width`` token numbers,
    each rolled from its neighbours by the same few vector operations."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _MUL + x[k: k + n]
    return out


class PassageIndex:
    """The passages of one block: token numbers, and their seeds in hash order."""

    def __init__(self, passages: list[tuple[object, str | None]], min_tile: int):
        self.min_tile = min_tile
        self.keys, self.ids, self.vocab = [], [], {}
        hashes, owner, place = [np.empty(0, np.uint64)], [], []
        for key, text in passages:
            words = tokens(text)
            own = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64)
            self.keys.append(key)
            self.ids.append(own)
            h = window_hashes(own, min_tile)
            hashes.append(h)
            owner += [len(self.keys) - 1] * len(h)
            place += range(len(h))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.array(owner, np.int64)[order]
        self.place = np.array(place, np.int64)[order]

    def seeds(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(passage, places in the document, places in the passage) of the shared runs."""
        n = len(doc) - self.min_tile + 1
        if n <= 0 or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(doc >= 0)])
        at = np.flatnonzero(known[self.min_tile:] - known[:n] == self.min_tile)  # unknown words match nothing
        if not len(at):
            return
        h = window_hashes(doc, self.min_tile)[at]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        slot = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        where, owner, place = np.repeat(at[hit], count), self.owner[slot], self.place[slot]
        for p in np.unique(owner):
            own = owner == p
            i, j = where[own], place[own]
            same = np.ones(len(i), bool)
            for k in range(self.min_tile):  # equal hashes are confirmed on the tokens
                same &= doc[i + k] == self.ids[p][j + k]
            if same.any():
                yield int(p), i[same], j[same]

    def match(self, text: str | None, least: float) -> list[tuple[object, float, int]]:
        """(key, coverage, tiles) of the passages covered to ``least`` or more."""
        words = tokens(text)
        get = self.vocab.get
        doc = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        for p, i, j in self.seeds(doc):
            # Each passage token of a tile lies in a seed: a bound that spares hopeless tilings.
            reach = np.zeros(len(self.ids[p]) + 1, np.int64)
            np.add.at(reach, j, 1)
            np.add.at(reach, np.minimum(j + self.min_tile, len(self.ids[p])), -1)
            if np.count_nonzero(np.cumsum(reach)[:-1]) < least * len(self.ids[p]):
                continue
            tiles = greedy_tiles(i, j, self.min_tile)
            covered = sum(n for _, _, n in tiles) / len(self.ids[p])
            if covered >= least:
                out.append((self.keys[p], covered, len(tiles)))
        return out


def greedy_tiles(i: np.ndarray, j: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Seeds (document place, passage place) of ``width`` equal tokens -> tiles
    (document place, passage place, length): the longest match of unmarked
    tokens first, ties by passage place, then document place."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + width - 1
    heap = [(-int(n), int(j[f]), int(i[f])) for n, f in zip(length, first)]
    heapq.heapify(heap)
    doc_marked: set[int] = set()
    test_marked: set[int] = set()
    tiles = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        free = [a + k not in doc_marked and b + k not in test_marked for k in range(n)]
        if all(free):
            tiles.append((a, b, n))
            doc_marked.update(range(a, a + n))
            test_marked.update(range(b, b + n))
            continue
        k = 0
        while k < n:  # what is left unmarked competes again at its own length
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= width:
                heapq.heappush(heap, (k - end, b + k, a + k))
            k = end
    return tiles


def passage_blocks(tests: DataFrame, id_col: str, text_col: str, block_tokens: int) -> Iterator[list[tuple[object, str | None]]]:
    """The test passages in blocks of about ``block_tokens`` words: each block
    is collected (its size is set by the sums taken first), the table never is.
    Rows with a null text, which match nothing, are left out."""
    t = tests.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.length(F.col(text_col)) / 4 + 1).alias("_n"))
    total = t.agg(F.sum("_n")).first()[0] or 0
    blocks = int(total // block_tokens) + 1
    for k in range(blocks):
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == k)
        yield sorted(((r[0], r[1]) for r in part.select("_id", "_text").toLocalIterator()), key=str)


MATCHES = "array<struct<item_id:bigint,coverage:double,tiles:int>>"


def add_matches(docs: DataFrame, tests: DataFrame, text_col: str = "text", test_id: str = "item_id",
                test_text: str = "text", min_tile: int = 5, least: float = 0.6, block_tokens: int = 2_000_000,
                out: str = "matches") -> DataFrame:
    """``docs`` with ``out``: the passages (item_id, coverage, tiles) that the
    document covers to the share ``least`` or more, by item.

    Null and empty texts, and passages of fewer than ``min_tile`` tokens, match
    nothing; equal passages each match.  A column named ``out`` is replaced.
    """
    src = docs.drop(out)
    got = src.withColumn(out, F.array().cast(MATCHES))
    schema = got.schema
    at = src.columns.index(text_col)
    for passages in passage_blocks(tests, test_id, test_text, block_tokens):
        index = docs.sparkSession.sparkContext.broadcast(PassageIndex(passages, min_tile))

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            kind = None
            for b in rows_in(batches):
                kind = kind or b.schema.field(len(b.schema) - 1).type
                found = []
                for text, before in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                    new = [{"item_id": k, "coverage": c, "tiles": n} for k, c, n in index.value.match(text, least)]
                    found.append(sorted(before + new, key=lambda m: (m["item_id"] is None, m["item_id"])))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], schema=b.schema)

        got = got.mapInArrow(run, schema)
    return got


def contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per contaminated document and passage: id_col, item_id,
    coverage, tiles.  Clean documents give no row."""
    found = add_matches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), tests, "_text", out="_m", **options)
    return found.select(F.col("_id").alias(id_col), F.inline("_m"))


def keep_clean(docs: DataFrame, tests: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a covered passage, with the columns of ``docs``."""
    (out,) = free_names(docs, "_matches")
    return add_matches(docs, tests, text_col, out=out, **options).where(F.size(out) == 0).drop(out)
