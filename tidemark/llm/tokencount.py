"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold the lengths and
token counts of some ``LEAF`` consecutive pre-tokens, inner nodes the sums below
them.  An edit (at, delete, insert) descends to the leaf by character sums,
splits the text again from the pre-token before the edit (with ``CONTEXT``
characters to spare, as far as the pattern looks ahead) up to the first
boundary behind it that was one before, encodes only those pre-tokens, replaces
them, and updates the sums on the paths above the leaves it touched.

From an old boundary on the text is as it was, and the pattern only looks ahead,
so the remaining pre-tokens are those of before: counts equal a full encoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rows_in

LEAF = 64
#: The pattern decides on a pre-token by at most so many characters behind it.
CONTEXT = 3
CACHE_PIECES = 300_000
EDIT = "struct<at:bigint,del:bigint,ins:string>"


class PieceCounter:
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("edit-aware", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= CACHE_PIECES:
                self.seen = {}
            n = self.seen[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        try:
            return [self.seen[p] for p in pieces]
        except KeyError:
            return [self.count(p) for p in pieces]


@lru_cache(maxsize=2)
def piece_counter(ranks_path: str, pattern: str) -> PieceCounter:
    return PieceCounter(ranks_path, pattern)


class CountTree:
    """The segment tree of one document."""

    def __init__(self, text: str, counter: PieceCounter):
        self.text, self.counter, self.encoded = text, counter, 0
        self.leaves: list[tuple[list[int], list[int]]] = []
        step = 1 << 16
        pieces: list[str] = []
        for m in counter.pattern.finditer(text) if len(text) > step else ():  # long texts: a bounded number of pieces at a time
            pieces.append(m.group())
            if len(pieces) == LEAF * 64:
                self._append(pieces)
                pieces = []
        if len(text) <= step:
            pieces = counter.pattern.findall(text)
        self._append(pieces)
        self._plant()

    def _append(self, pieces: list[str]) -> None:
        lens, nums = list(map(len, pieces)), self.counter.counts(pieces)
        for k in range(0, len(pieces), LEAF):
            self.leaves.append((lens[k: k + LEAF], nums[k: k + LEAF]))

    def _plant(self) -> None:
        """Sums bottom-up; node i has the children 2i and 2i+1."""
        self.leaves = self.leaves or [([], [])]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (lens, nums) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(lens), sum(nums)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> int:
        return sum(len(x[0]) for x in self.leaves)

    def _set(self, k: int, lens: list[int], nums: list[int]) -> None:
        self.leaves[k] = (lens, nums)
        i = self.width + k
        self.chars[i], self.tokens[i] = sum(lens), sum(nums)
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character ``offset`` (the last one for the end), and where it starts."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if offset >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.width, len(self.leaves) - 1), before

    def edit(self, at: int, delete: int, insert: str) -> int:
        """Replace ``delete`` characters at ``at``; both are cut to the text.
        Returns the number of pre-tokens encoded again."""
        at = min(max(at, 0), len(self.text))
        end = min(at + max(delete, 0), len(self.text))
        new = self.text[:at] + insert + self.text[end:]
        shift, behind = len(new) - len(self.text), at + len(insert)
        first, start = self._leaf_at(max(0, at - CONTEXT))
        lens, nums = self.leaves[first]
        keep = 0
        while keep < len(lens) and start + lens[keep] <= max(0, at - CONTEXT):
            start += lens[keep]
            keep += 1
        # Old boundaries from there on: leaf ``last`` up to its piece ``gone``, which ends at ``old``.
        last, gone, old = first, keep, start
        pos, fresh = start, []
        while pos < len(new):
            m = self.counter.pattern.match(new, pos)
            fresh.append(m.group())
            pos = m.end()
            if pos >= behind:
                while old < pos - shift:
                    if gone == len(self.leaves[last][0]):
                        last, gone = last + 1, 0
                        continue
                    old += self.leaves[last][0][gone]
                    gone += 1
                if old == pos - shift:
                    break
        else:
            last, gone = len(self.leaves) - 1, len(self.leaves[-1][0])
        tail = self.leaves[last][0][gone:], self.leaves[last][1][gone:]
        self.text = new
        for k in range(first + 1, last + 1):
            self._set(k, [], [])
        self._set(first, lens[:keep] + list(map(len, fresh)) + tail[0], nums[:keep] + self.counter.counts(fresh) + tail[1])
        if len(self.leaves[first][0]) > 16 * LEAF:  # grown too wide: plant anew, which encodes nothing
            flat = [x for leaf in self.leaves for x in zip(*leaf)]
            self.leaves = [([c for c, _ in flat[k: k + LEAF]], [n for _, n in flat[k: k + LEAF]]) for k in range(0, len(flat), LEAF)]
            self._plant()
        self.encoded += len(fresh)
        return len(fresh)


def count_edits(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", edits_col: str = "edits",
                out: str = "counts") -> DataFrame:
    """``docs`` (with ``edits_col``, an array of struct<at, del, ins> in code
    points, applied one after the other) with ``out``: struct<n_tokens: before,
    n_edited: after, pieces: pre-tokens before, reencoded: pre-tokens encoded
    again for all edits, edited: the text after them>.

    A null text counts as empty, a null edit list or edit changes nothing, null
    fields count as 0 and "", and places beyond the text as its end.  A column
    named ``out`` is replaced; rows stay where they are.
    """
    src = docs.drop(out)
    kind = "struct<n_tokens:bigint,n_edited:bigint,pieces:bigint,reencoded:bigint,edited:string>"
    schema = src.select("*", F.lit(None).cast(kind).alias(out)).schema
    at_text, at_edits = src.columns.index(text_col), src.columns.index(edits_col)
    arrow = pa.struct([("n_tokens", pa.int64()), ("n_edited", pa.int64()), ("pieces", pa.int64()), ("reencoded", pa.int64()), ("edited", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(ranks_path, pattern)
        for b in rows_in(batches):
            got = []
            for text, edits in zip(b.column(at_text).to_pylist(), b.column(at_edits).to_pylist()):
                tree = CountTree(text or "", counter)
                before, pieces = tree.total, tree.pieces
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["at"] or 0, e["del"] or 0, e["ins"] or "")
                got.append({"n_tokens": before, "n_edited": tree.total, "pieces": pieces, "reencoded": tree.encoded, "edited": tree.text})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], names=[*b.schema.names, out])

    return src.mapInArrow(run, schema)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", out: str = "edits") -> DataFrame:
    """``docs`` with the edits (id_col, seq, at, del, ins) of each, in order of seq."""
    per = edits.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "at", "del", "ins"))), lambda e: F.struct(e["at"], e["del"], e["ins"])).cast(f"array<{EDIT}>").alias(out))
    return docs.drop(out).join(per, id_col, "left")
