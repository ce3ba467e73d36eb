"""Ranked lexical search by a dual-tree descent, exact.

Items come in blocks of a bounded number of terms.  For each block the texts are
read once, to a table of the counts of the block's terms in each document, from
which follow the document frequencies and the weights.  A task then takes the
documents in chunks and builds two hierarchies: one over the items (the same in
all tasks) whose nodes hold, for each term, the greatest weight of their items,
and one over the chunk's documents whose nodes hold the greatest share of a
score that any of their documents gets from the term.  The product of two nodes
bounds the score of every document below the one for every item below the other.
Pairs of nodes are opened from the roots down; a pair whose bound is less than
the weakest k-th best score of its items is dropped with all that it holds.
Leaves are scored exactly, best bound first, so that k-th scores rise early.

A first pass over a sixteenth of the documents (by hash) gives each item a k-th
score that all other tasks start from; it spares work and changes no result, as
both passes together cover every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import row_number_by
from ..session import materialize, scratch_path
from ._common import rows_by_size

#: A block of items has at most so many, each of at most BLOCK_TERMS terms; of
#: items with more terms, a block has fewer, and at least one.
BLOCK_ITEMS = BLOCK_TERMS = 256
FIRST_PASS = 16
#: Cells of a chunk's table of documents and terms: 32 MB.
CHUNK_CELLS = 1 << 23
CHUNK_DOCS = 2048
ITEM_LEAF, DOC_LEAF, FAN = 4, 16, 4

_SEPARATORS = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_FOLD = bytes(0x20 if _SEPARATORS.match(bytes([c])) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, in lists for about ``size`` bytes."""
    folded = text.translate(_FOLD)  # separators are ASCII, so bytes serve
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size) if at + size < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


# ---------------------------------------------------------------- items


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], pa.Array, list[list[bytes]]]]:
    """Blocks of (numbers, ids, terms of each item), collected one at a time."""
    rows = items.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").distinct()
    out = T.StructType([rows.schema["_id"], T.StructField("_terms", T.ArrayType(T.BinaryType()))])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            terms = [sorted({t for run in term_runs(x) for t in run}) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["_id", "_terms"])

    rows = materialize(rows.mapInArrow(cut, out).where(F.size("_terms") > 0), "lexical-items")
    # Class c has items of up to BLOCK_TERMS * 2**c terms, so many fewer to a block.
    c = F.greatest(F.lit(0), F.ceil(F.log2(F.size("_terms") / F.lit(float(BLOCK_TERMS))))).cast("int")
    rows = materialize(row_number_by(rows.withColumn("_class", c), [F.col("_id").asc_nulls_last(), F.col("_terms").asc()], by=["_class"]), "lexical-numbered")
    for kind, n in sorted(tuple(r) for r in rows.groupBy("_class").agg(F.max("rn")).collect()):
        per = max(1, BLOCK_ITEMS >> kind)
        for first in range(1, n + 1, per):
            got = rows.where((F.col("_class") == kind) & F.col("rn").between(first, first + per - 1)).orderBy("rn").toArrow()
            yield got["rn"].to_pylist(), got["_id"].combine_chunks(), got["_terms"].to_pylist()


def halves(rows: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows that keeps like ones near: split at the median along
    the main direction, again and again down to ``leaf`` rows."""
    def split(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= leaf:
            return [at]
        x = rows[at] - rows[at].mean(axis=0)
        far = x[np.argmax(np.einsum("ij,ij->i", x, x))]
        for _ in range(6):
            far = x.T @ (x @ far)
            norm = np.linalg.norm(far)
            if not norm:
                break
            far /= norm
        at = at[np.argsort(x @ far, kind="stable")]
        middle = leaf * max(1, math.ceil(len(at) / leaf) // 2)
        return split(at[:middle]) + split(at[middle:])

    return np.concatenate(split(np.arange(len(rows))))


def pyramid(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of nodes, level by level: leaves of ``leaf`` rows first,
    then nodes of ``FAN`` nodes, up to one root."""
    levels, width = [], leaf
    while True:
        short = -len(rows) % width
        if short:
            rows = np.concatenate([rows, np.zeros((short, rows.shape[1]), rows.dtype)])
        rows = rows.reshape(-1, width, rows.shape[1]).max(axis=1)
        levels.append(rows)
        if len(rows) == 1:
            return levels
        width = FAN


class ItemTree:
    """Items of a block in tree order, with the terms that their nodes hold."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        w = np.zeros((len(terms), len(weights)))
        for i, t in enumerate(terms):
            w[i, t] = weights[t]
        self.order = halves(w.astype(np.float32), ITEM_LEAF)
        w = w[self.order]
        self.levels = []
        for level in pyramid(w, ITEM_LEAF):
            self.levels.append([(cols, node[cols]) for node in level for cols in [np.flatnonzero(node)]])
        self.leaves = []
        for n, (cols, _) in enumerate(self.levels[0]):
            self.leaves.append(np.ascontiguousarray(w[n * ITEM_LEAF: (n + 1) * ITEM_LEAF, cols].T))
        groups = next(level for level in self.levels if len(level) <= 8)
        self.groups = np.zeros((len(weights), len(groups)), np.float32)
        for g, (cols, maxima) in enumerate(groups):
            self.groups[cols, g] = maxima


# ---------------------------------------------------------------- documents


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents with a term -> _id, _n (terms with repeats), and _t, _f: the
    vocabulary's terms that it holds, and how often."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    out = T.StructType([rows.schema["_id"], T.StructField("_n", T.LongType()), T.StructField("_t", T.ArrayType(T.IntegerType())),
                        T.StructField("_f", T.ArrayType(T.LongType()))])
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in rows_by_size(batches, 1, 1 << 22):
            n, t, f, ends = [], [], [], [0]
            for text in b.column(1).cast(pa.binary()).to_pylist():
                total, counts = 0, Counter()
                for terms in term_runs(text):
                    total += len(terms)
                    counts.update(map(get, terms))
                counts.pop(None, None)
                n.append(total)
                t.extend(counts)
                f.extend(counts.values())
                ends.append(len(t))
            ends = pa.array(ends, pa.int32())
            got = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(t, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(f, pa.int64()))], names=["_id", "_n", "_t", "_f"])
            yield got.filter(pc.greater(got["_n"], 0))

    return materialize(rows.mapInArrow(run, out), "lexical-counts")


def shares(n: np.ndarray, f: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term of weight 1 adds to a score: its occurrences ``f`` in a
    document of ``n`` terms, where ``docs`` documents have ``words`` terms."""
    kind = np.int64 if 50 * int(n.max(initial=0)) * docs < 1 << 62 else object
    m = (50 + (50 * n.astype(kind) * docs) // words).astype(np.int64)
    return (1_000_000_000 * f) // (1000 * f + 20 * m)


class Search:
    """The documents of a task, chunk by chunk, against the items of a block."""

    def __init__(self, tree: ItemTree, terms: int, docs: int, words: int, k: int, floors: np.ndarray):
        self.tree, self.terms, self.docs, self.words, self.k = tree, terms, docs, words, k
        self.best = np.zeros((len(tree.order), k), np.int64)  # the best scores met, in tree order
        self.least = np.maximum(floors[tree.order], 1)  # no score below can be among the k best
        self.scored = self.pairs = 0

    def chunk(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, f: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, scores) of the documents that may be among the item's k
        best: those of a score of ``least`` or more, k at most, ties by place."""
        table = np.zeros((len(n), self.terms), np.float32)
        table[doc, term] = shares(n[doc], f, self.docs, self.words)
        like = table @ self.tree.groups
        order = np.lexsort((n, like.argmax(axis=1)))  # near documents together, by the items that they suit
        table = table[order]
        levels = pyramid(table, DOC_LEAF)
        a, b = len(self.tree.levels) - 1, len(levels) - 1
        front = {0: np.zeros(1, np.int64)}
        while True:
            width = ITEM_LEAF * FAN**a
            opened = {}
            for i, nodes in front.items():
                cols, maxima = self.tree.levels[a][i]
                bound = levels[b][nodes][:, cols].astype(np.float64) @ maxima
                keep = bound >= self.least[i * width: (i + 1) * width].min()
                if keep.any():
                    opened[i] = (nodes[keep], bound[keep])
            if not a + b:
                break
            front = {}
            for i, (nodes, _) in opened.items():
                if b:
                    nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                    nodes = nodes[nodes < len(levels[b - 1])]
                for child in range(i * FAN, min((i + 1) * FAN, len(self.tree.levels[a - 1]))) if a else [i]:
                    front[child] = nodes
            a, b = max(0, a - 1), max(0, b - 1)
        self.pairs += len(n) * len(self.tree.order)
        for i, (nodes, bound) in opened.items():
            yield from self._leaf(i, nodes[np.argsort(-bound, kind="stable")], np.sort(bound)[::-1], table, order)

    def _leaf(self, i: int, nodes: np.ndarray, bound: np.ndarray, table: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """One leaf of items against leaves of documents, best bound first."""
        cols, weights = self.tree.levels[0][i][0], self.tree.leaves[i]
        own = range(i * ITEM_LEAF, i * ITEM_LEAF + weights.shape[1])
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in own]
        for at in range(0, len(nodes), 8):
            if bound[at] < self.least[own.start: own.stop].min():
                break
            rows = (nodes[at: at + 8, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
            rows = rows[rows < len(order)]
            scores = (table[rows][:, cols].astype(np.float64) @ weights).astype(np.int64)  # whole numbers below 2**53
            self.scored += scores.size
            for j, item in enumerate(own):
                got = scores[:, j]
                keep = got >= self.least[item]
                if keep.any():
                    found[j].append((order[rows[keep]], got[keep]))
                    pool = np.concatenate([self.best[item], got[keep]])
                    self.best[item] = np.partition(pool, len(pool) - self.k)[-self.k:]
                    self.least[item] = max(self.least[item], self.best[item].min())
        for j, item in enumerate(own):
            if found[j]:
                places, scores = (np.concatenate(x) for x in zip(*found[j]))
                keep = scores >= self.least[item]
                places, scores = places[keep], scores[keep]
                near = np.lexsort((places, -scores))[: self.k]
                yield int(self.tree.order[item]), places[near], scores[near]


def _search(make, ids: pa.Array, chunk_docs: int):
    """Counts of documents -> (_i, item_id, _id, _score)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = make()
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, t.num_rows, chunk_docs):
                part = t.slice(at, chunk_docs).combine_chunks()
                part = part.take(pc.sort_indices(part["_id"], null_placement="at_end")).combine_chunks()  # places order ties
                lists, counts = part["_t"].combine_chunks(), part["_f"].combine_chunks()
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                out_i, out_at, out_s = [], [], []
                for item, places, scores in search.chunk(part["_n"].to_numpy(), doc, lists.flatten().to_numpy(), counts.flatten().to_numpy()):
                    out_i.append(np.full(len(places), item, np.int32))
                    out_at.append(places)
                    out_s.append(scores)
                if out_i:
                    items = pa.array(np.concatenate(out_i))
                    yield pa.RecordBatch.from_arrays([items, ids.take(items), part["_id"].combine_chunks().take(pa.array(np.concatenate(out_at))),
                                                      pa.array(np.concatenate(out_s))], names=["_i", "_item", "_id", "_score"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_docs:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()
    return run


# ---------------------------------------------------------------- the operator


def _block(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, numbers: list[int], ids: pa.Array, terms: list[list[bytes]],
           k: int, item_type: T.DataType, totals: tuple[int, int] | None, chunk_docs: int) -> tuple[DataFrame | None, tuple[int, int]]:
    """(item_id, rank, id_col, score) of one block of items, and the totals of the corpus."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in terms for t in item}))}
    counts = count_terms(docs, id_col, text_col, vocabulary)
    if totals is None:
        totals = tuple(int(x) for x in counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first())
    n, words = totals
    if not n:
        return None, totals
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in counts.select(F.explode("_t").alias("_t")).groupBy("_t").count().collect():  # a row for each term at most
        df[t] = c
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(c) + 1))) for c in df], np.float64)
    shared = spark.sparkContext.broadcast(ItemTree([np.array([vocabulary[t] for t in item]) for item in terms], weights))
    size = max(1, min(chunk_docs, CHUNK_CELLS // len(vocabulary)))
    schema = T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("_item", item_type), counts.schema["_id"], T.StructField("_score", T.LongType())])
    w = Window.partitionBy("_i").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last())

    def search(part: DataFrame, floors: np.ndarray) -> DataFrame:
        def make(tree=shared, floors=floors, terms=len(vocabulary)) -> Search:
            return Search(tree.value, terms, n, words, k, floors)

        hits = part.mapInArrow(_search(make, ids, size), schema)
        return hits.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)

    first = F.pmod(F.xxhash64("_id", "_n"), F.lit(FIRST_PASS)) == 0
    start = materialize(search(counts.where(first), np.zeros(len(ids), np.int64)), "lexical-first", 1)
    floors = np.zeros(len(ids), np.int64)
    for i, score in start.where(F.col("_rank") == k).select("_i", "_score").collect():  # a row for each item of the block at most
        floors[i] = score
    both = start.drop("_rank").unionByName(search(counts.where(~first), floors).drop("_rank"))
    return both.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k), totals


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """The ``k`` documents of the highest score above 0 for each item: item_id,
    rank (from 1), id_col, score; equal scores by id (null last).

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, with A-Z lower-cased.  Null and empty texts, and texts without a term,
    have none: such documents count nowhere, such items give no row.  Each row
    of ``items`` is an item: rows equal in id and text are one, others that share
    an id are ranked one by one.  Rows of ``docs`` that share an id are documents
    of their own.  Texts are cut a megabyte at a time.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    path, totals, wrote = scratch_path(spark, "lexical-hits"), None, False
    for numbers, ids, terms in item_blocks(items, item_id, item_text):
        best, totals = _block(spark, docs, id_col, text_col, numbers, ids, terms, k, item_type, totals, chunk_docs)
        if best is None:
            break
        (best.select(F.col("_item").alias("item_id"), F.col("_rank").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))
         .write.mode("append").parquet(path))
        wrote = True
    return spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, n_docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total
  GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
