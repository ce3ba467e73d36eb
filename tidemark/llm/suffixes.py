"""Exact repeats by a distributed difference-cover suffix sort, to a fixed depth.

A byte is a repeat when a string of ``length`` bytes that covers it also starts
elsewhere.  Sorting all suffixes would bring such strings next to each other;
this is done the difference-cover way, and only as deep and for as many
suffixes as it takes to tell.

*Sample.*  D is a set of residues modulo a period v of which every residue is a
difference; position i of a document is sampled when i mod v is in D.  For any
two positions i, j some offset d < v has i + d and j + d both sampled.  So two
equal strings share, d bytes in, two sampled suffixes that agree for
length - d > length - v bytes.

1. *Sort the sampled tuples* (three symbols in the textbook, v bytes here): each
   is named, and a name that occurs once settles the suffixes through it.
2. *Recurse on names*: the names at s, s + v, ... are the shorter string that
   the recursion works on.  A suffix stays only where all its tuples within
   length - v + 1 bytes repeat.  Of what stays, the strings from one sampled
   position to the next and ``length`` bytes beyond are named and sorted: where
   such a string repeats, all its bytes do.
3. *Merge the remaining suffixes*: those in strings that didn't repeat ask, and
   one copy of each repeated string answers, wherever its sampled tuples are
   also those of a suffix that asks.
4. *Compare adjacent prefixes*: sorted to the full depth, equal neighbours are
   repeats.

Names are Karp-Rabin fingerprints, where the name of a longer prefix follows
from those of its parts.  A round of names goes through one shuffle: a range of
names is sorted in one task (as many ranges as names need), and every block of
documents sends a name once, whatever its copies.  So a passage that a third of
all documents hold arrives once per block, and no task gathers its places.
Tuples only rule out; the answers come from 64-bit names.  The number of the
range is a second hash, but only of as many values as there are ranges, so it
adds log2(ranges) bits.

*Passages.*  The same steps, in the same rounds, can run on words in place of
bytes: the symbols are hashes of words, the length is a number of words, and only
a string that another document holds counts.  That finds passages that are long
in words and too short in bytes to be removed.

The headings are the textbook's.  The recursion is unrolled to rounds of a fixed
number that filter by fingerprint, and no order of suffixes is made or merged.

Blocks are rows of Parquet tables in the shared folder; questions and answers
are keyed by block, and a lost executor reads the tables again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._common import rows_in, utf8

#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK = 2 << 20
#: Names that one range task sorts, about.
RANGE = 1 << 20
#: Bytes that are hashed at a time, so few that a core's cache holds the sums.
STRETCH = 1 << 15
#: Perfect difference sets modulo 133 and 21 (every residue but 0 is a difference exactly once).
COVERS = {133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109), 21: (0, 1, 4, 14, 16)}
#: White space between words, by byte.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

ELSEWHERE, LEAST, ASKED = 1, 2, 4  # bits of an answer


def difference_cover(period: int) -> np.ndarray:
    """Residues modulo ``period`` of which every residue is a difference; 0 is one of them."""
    s = int(np.ceil(np.sqrt(period)))
    return np.array(sorted(COVERS.get(period) or {*range(s), *range(0, period, s)}))


# ---------------------------------------------------------------- fingerprints


@lru_cache(maxsize=4)
def _family(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, and the powers of an odd base and of its inverse modulo 2^64."""
    rng = np.random.default_rng(1000 + which)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(2**59, 2**60)) * 8 + 5
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(mark: np.ndarray) -> np.ndarray:
    """How many marks there are before each position, and in all."""
    total = np.zeros(len(mark) + 1, np.int64 if len(mark) >> 31 else np.int32)
    np.cumsum(mark, out=total[1:], dtype=total.dtype)
    return total


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fingerprints(data: np.ndarray, at: np.ndarray, length: int | np.ndarray, which: int) -> np.ndarray:
    """64-bit names of data[at : at + length] (``at`` ascending), in stretches so
    that memory doesn't grow with the text.  ``data``: bytes, or 64-bit hashes."""
    out = np.empty(len(at), np.uint64)
    lens = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    longest = int(lens.max()) if len(at) else 0
    over = (longest // 4096 + 1) * 4096
    stretch = max(STRETCH, over)
    values, up, down = _family(which, stretch + over)
    cuts = np.searchsorted(at, np.arange(0, len(data) + stretch, stretch))
    for k in range(len(cuts) - 1):
        lo, hi = cuts[k], cuts[k + 1]
        if lo == hi:
            continue
        start = k * stretch
        part = data[start: start + stretch + longest]
        total = np.zeros(len(part) + 1, np.uint64)
        coded = values[part] if part.dtype == np.uint8 else _mix(part + values[0])
        np.cumsum(coded * up[: len(part)], out=total[1:])
        i = at[lo:hi] - start
        h = (total[i + lens[lo:hi]] - total[i]) * down[i]
        out[lo:hi] = _mix(h + lens[lo:hi].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def words_of(lens: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words each document has, and the words' hashes; no word reaches
    over the end of a document."""
    begin = np.concatenate([[0], np.cumsum(lens)])
    first, last = begin[:-1][lens > 0], begin[1:][lens > 0] - 1
    inside = ~SPACE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    head[first], tail[last] = inside[first], inside[last]
    at = np.flatnonzero(head)
    return np.diff(np.searchsorted(at, begin)), fingerprints(data, at, np.flatnonzero(tail) + 1 - at, 2)


# ---------------------------------------------------------------- blocks


class Block:
    """Documents laid end to end (as bytes or hashes of words), and their sampled positions."""

    def __init__(self, lens: np.ndarray, data: np.ndarray, period: int):
        self.lens, self.data = lens, data
        self.begin = np.concatenate([[0], np.cumsum(lens)])
        times = -(-lens // period)
        tiles = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = (np.repeat(self.begin[:-1], times) + tiles * period)[:, None] + difference_cover(period)
        self.sampled = at[at < np.repeat(self.begin[1:], times)[:, None]]

    def start(self, at: np.ndarray) -> np.ndarray:
        """Where the documents of these positions start."""
        return self.begin[np.searchsorted(self.begin, at, "right") - 1]

    def end(self, at: np.ndarray) -> np.ndarray:
        return self.begin[np.searchsorted(self.begin, at, "right")]

    def whole(self, period: int) -> np.ndarray:
        """The sampled positions with a whole tuple."""
        return self.sampled[self.sampled + period <= self.end(self.sampled)]


def _pack(arr: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(arr.tobytes())


def _unpack(raw: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _block_rows(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size, kind = [], [], 0, None

        def block():
            lens = np.array([len(t) for t in texts], np.int64)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([lens.tolist()], pa.list_(pa.int64())), pa.array([_pack(raw)], pa.binary())],
                names=["block", "ids", "lens", "data"])

        for b in rows_in(batches):
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = utf8(text)
                if texts and size + len(raw) > block_bytes:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(key)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield block()

    return src.mapInArrow(run, f"block bigint, ids array<{id_type}>, lens array<bigint>, data binary")


# ---------------------------------------------------------------- a round of names


class Names:
    """The names a block sends: distinct (range, name) pairs in order, and for
    each place which of them it has.  With ``owners``, by place, a name is
    elsewhere in the block where it has another owner."""

    def __init__(self, ranges: np.ndarray, names: np.ndarray, asks: np.ndarray | None = None, owners: np.ndarray | None = None):
        if names.dtype.itemsize == 4:
            order = np.argsort((ranges << np.uint64(32)) | names)
        else:
            order = np.argsort(names)
            small = ranges.astype(np.uint16) if not len(ranges) or ranges.max() < 1 << 16 else ranges  # sorted by radix
            order = order[np.argsort(small[order], kind="stable")]
        r, v = ranges[order], names[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        group = np.cumsum(new) - 1
        self.which = np.empty(len(r), np.int64)
        self.which[order] = group
        self.ranges, self.names = r[new], v[new]
        at = np.flatnonzero(new)
        self.first = np.zeros(len(r), bool)  # the first place of each name
        self.first[np.minimum.reduceat(order, at) if len(at) else at] = True
        if owners is None or not len(at):
            self.many = np.diff(at, append=len(r)) > 1
        else:
            self.many = np.minimum.reduceat(owners[order], at) != np.maximum.reduceat(owners[order], at)
        self.asks = np.zeros(len(self.names), np.uint8)
        if asks is not None:
            np.bitwise_or.at(self.asks, self.which, asks.astype(np.uint8))

    def messages(self, block: int) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(self.ranges, prepend=-1)) if len(self.ranges) else np.empty(0, int)
        ends = [*cut[1:].tolist(), len(self.ranges)]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ranges[cut].astype(np.int64)), pa.array(np.full(len(cut), block, np.int64)),
             pa.array([self.names[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
             pa.array([self.asks[a:b].tobytes() if self.asks[a:b].any() else None for a, b in zip(cut, ends)], pa.binary())],
            names=["range", "block", "names", "asks"])

    def answers(self, got: list | None) -> np.ndarray:
        """For each place: the answer's bits, with what the block itself knows."""
        code = np.full(len(self.names), LEAST, np.uint8)  # ranges where all is so send no answer
        for a in got or ():
            k = int(np.searchsorted(self.ranges, np.uint64(a["range"])))
            if k == len(self.ranges) or self.ranges[k] != a["range"]:  # a range of the block's other names
                continue
            raw = np.frombuffer(a["bits"], np.uint8)
            code[k: k + len(raw)] = raw
        code |= self.many * np.uint8(ELSEWHERE) | (self.asks * np.uint8(ASKED))
        return code[self.which]


MESSAGE = "range bigint, block bigint, names binary, asks binary"
ANSWER = "block bigint, range bigint, bits binary"


def _sorted_range(table: pa.Table, kind: str) -> pa.Table:
    """One range: all names sent to it, sorted; each sender's answers."""
    names = [np.frombuffer(x.as_py(), kind) for x in table["names"]]
    asks = [np.zeros(len(n), np.uint8) if a.as_py() is None else np.frombuffer(a.as_py(), np.uint8) for n, a in zip(names, table["asks"])]
    blocks = table["block"].to_numpy()
    every = np.concatenate(names)
    owner = np.repeat(np.arange(len(names)), [len(n) for n in names])
    order = np.lexsort((blocks[owner], every))
    v = every[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]  # adjacent prefixes compared
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    asked = np.zeros(len(many), np.uint8)
    np.bitwise_or.at(asked, group, np.concatenate(asks)[order])
    code = np.empty(len(v), np.uint8)
    code[order] = many[group] * ELSEWHERE | new * LEAST | asked[group] * ASKED
    cut = np.cumsum([len(n) for n in names])[:-1]
    rows = [(int(b), part) for b, part in zip(blocks, np.split(code, cut)) if (part != LEAST).any()]
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "range": pa.array([table["range"][0].as_py()] * len(rows), pa.int64()),
                     "bits": pa.array([p.tobytes() for _, p in rows], pa.binary())})


def _ask(rows: DataFrame, names_of: Callable[[dict], Iterable[Names]], kind: str, step: str) -> DataFrame:
    """One round: every block's names out, sorted by range, answers back as
    (block, answers_<step>)."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches, 1):
            row = b.to_pylist()[0]
            for names in names_of(row):
                yield names.messages(row["block"])

    told = rows.mapInArrow(send, MESSAGE).groupBy("range").applyInArrow(lambda t: _sorted_range(t, kind), ANSWER)
    return materialize(told.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias(f"answers_{step}")), f"answers-{step}")


def _ranges(h: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)) + np.uint64(first)


# ---------------------------------------------------------------- the steps


class Depth:
    """What the steps compute for one block; ``length`` and ``period`` fixed.

    ``words``: on words, and repeats are those across documents.  ``which``: the
    place among the depths that share their rounds; ``first``: its first range.
    """

    def __init__(self, length: int, period: int, ranges: int, words: bool = False, which: int = 0, first: int = 0):
        if period > (length + 1) // 2:
            raise ValueError("the period must leave a whole tuple in length - period + 1 bytes")
        self.length, self.period, self.ranges = length, period, ranges
        self.words, self.which, self.first = words, which, first
        self.tiles = (length - period + 1) // period
        self.residues = len(difference_cover(period))

    def block(self, row: dict) -> Block:
        lens, data = np.array(row["lens"], np.int64), _unpack(row["data"])
        return Block(*(words_of(lens, data) if self.words else (lens, data)), self.period)

    def _zone_of(self, row: dict, b: Block) -> np.ndarray:
        return np.unpackbits(_unpack(row["zones"][self.which]), count=len(b.data)).astype(bool)

    def _owners(self, b: Block, at: np.ndarray) -> np.ndarray | None:
        return b.start(at) if self.words else None

    def _named(self, b: Block, at: np.ndarray, length, asks=None, owners=None) -> Names:
        return Names(_ranges(fingerprints(b.data, at, length, 0), self.ranges, self.first), fingerprints(b.data, at, length, 1), asks, owners)

    # 1. sampled tuples

    def tuples(self, row: dict, b: Block | None = None) -> Names:
        b = b or self.block(row)
        at = b.whole(self.period)
        h = fingerprints(b.data, at, self.period, 0)
        return Names(_ranges(h, self.ranges, self.first), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), owners=self._owners(b, at))

    # 2. names of names, and what may repeat

    def zone(self, row: dict, b: Block) -> np.ndarray:
        """By position: may a string of ``length`` bytes that starts here repeat?"""
        at = b.whole(self.period)
        repeats = np.zeros(len(b.data) + 1, bool)
        repeats[at[self.tuples(row, b).answers(row["answers_1"]) & ELSEWHERE > 0]] = True
        alive = at[at + self.tiles * self.period <= b.end(at)]
        for k in range(self.tiles):
            alive = alive[repeats[alive + k * self.period]]
        edge = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(edge, np.maximum(alive - self.period + 1, b.start(alive)), 1)
        np.add.at(edge, alive + 1, -1)
        may = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        for s, e in zip(b.begin[:-1].tolist(), b.begin[1:].tolist()):
            may[max(s, e - self.length + 1): e] = False
        return may

    def strings(self, b: Block, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sampled positions with a zone position before the next one: where
        they are, where the next one is, and whether their string fits."""
        here = b.sampled
        after = np.append(here[1:], len(b.data))
        after = np.minimum(after, b.end(here))
        inside = _sums(zone)
        some = inside[after] > inside[here]
        here, after = here[some], after[some]
        return here, after, after + self.length <= b.end(here)

    def string_names(self, row: dict, b: Block | None = None, zone: np.ndarray | None = None) -> Names:
        b = b or self.block(row)
        here, after, fits = self.strings(b, self._zone_of(row, b) if zone is None else zone)
        return self._named(b, here[fits], after[fits] - here[fits] + self.length, owners=self._owners(b, here[fits]))

    # 3. who asks, who answers

    def roles(self, row: dict, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By position: asks (zone, its string didn't repeat), may answer (zone,
        first copy of a repeated string); and the repeated strings (from, to)."""
        zone = self._zone_of(row, b)
        here, after, fits = self.strings(b, zone)
        names = self.string_names(row, b, zone)
        code = np.zeros(len(here), np.uint8)
        code[fits] = names.answers(row["answers_2"])
        least = np.zeros(len(here), bool)
        least[fits] = names.first
        least &= code & LEAST > 0
        repeats = code & ELSEWHERE > 0
        spread = np.zeros(len(b.data) + 1, np.int8)
        asks, answers = np.zeros(len(b.data), bool), np.zeros(len(b.data), bool)
        for out, some in ((asks, ~repeats), (answers, repeats & least)):
            spread[:] = 0
            np.add.at(spread, here[some], 1)
            np.add.at(spread, after[some], -1)
            out[:] = (np.cumsum(spread[:-1], dtype=np.int8) > 0) & zone
        return asks, answers, here[repeats], after[repeats] + self.length

    def class_names(self, row: dict, b: Block | None = None, roles=None) -> tuple[Names, np.ndarray]:
        """The tuples of names behind which a position asks or may answer."""
        b = b or self.block(row)
        asks, answers, _, _ = roles or self.roles(row, b)
        at = b.whole(self.tiles * self.period)
        low = np.maximum(at - self.period + 1, b.start(at))
        some = []
        for mark in (asks, answers):
            total = _sums(mark)
            some.append(total[at + 1] > total[low])
        keep = some[0] | some[1]
        return self._named(b, at[keep], self.tiles * self.period, some[0][keep]), at[keep]

    # 4. the remaining suffixes at full depth

    def suffix_names(self, row: dict, b: Block | None = None) -> tuple[Names, np.ndarray, np.ndarray, tuple]:
        b = b or self.block(row)
        roles = self.roles(row, b)
        asks, answers = roles[:2]
        names, at = self.class_names(row, b, roles)
        asked = at[names.answers(row["answers_3"]) & ASKED > 0]
        edge = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(edge, np.maximum(asked - self.period + 1, b.start(asked)), 1)
        np.add.at(edge, asked + 1, -1)
        send = np.flatnonzero(asks | (answers & (np.cumsum(edge, dtype=np.int32)[:-1] > 0)))
        # What answers has a copy in another document, so it is no document's own.
        owners = np.where(asks[send], b.start(send), -1) if self.words else None
        return self._named(b, send, self.length, owners=owners), send, asks, roles

    def covered(self, row: dict, b: Block) -> np.ndarray:
        """By position: is the byte (or word) in a repeat?"""
        names, send, asks, (_, _, start, stop) = self.suffix_names(row, b)
        hit = send[(names.answers(row["answers_4"]) & ELSEWHERE > 0) & asks[send]]
        edge = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(edge, np.concatenate([hit, start]), 1)
        np.add.at(edge, np.concatenate([hit + self.length, stop]), -1)
        return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, period: int = 133,
                   block_bytes: int = BLOCK, range_names: int = RANGE, passage_words: int | None = None, passage_period: int = 21) -> DataFrame:
    """One row per input row: id_col, n_bytes, ``spans`` (array of struct<from,
    to>: the maximal runs of repeated bytes, ``to`` left out) and ``kept`` (the
    other bytes).

    Texts are UTF-8 bytes, null counts as empty, and strings never reach over
    the end of a document.  Rows with equal ids are documents of their own.
    Texts shorter than ``length`` repeat nothing.  No other column is read; an
    empty table gives no rows.

    ``passage_words``: a further column ``n_passage_words``, the words that lie
    in a run of so many words that another document holds too, whatever white
    space is between them.  It removes nothing.
    """
    blocks = materialize(_block_rows(docs, id_col, text_col, block_bytes), "blocks")
    n_bytes = blocks.agg(F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]

    def ranges(n: int, period: int) -> int:
        return max(1, int(n * len(difference_cover(period)) / period / range_names))

    depths = [Depth(length, period, ranges(n_bytes, period))]
    if passage_words is not None:  # four bytes a word, so that short words don't fill a range
        depths.append(Depth(passage_words, passage_period, ranges(n_bytes // 4, passage_period), words=True, which=1, first=depths[0].ranges))
    ids_type = blocks.schema["ids"].dataType.simpleString()

    def answered(rows: DataFrame, *steps: DataFrame) -> DataFrame:
        for s in steps:
            rows = rows.join(s, "block", "left")
        return rows

    one = _ask(blocks, lambda row: [d.tuples(row) for d in depths], "<u4", "1")

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block as two rows: the documents that are settled, and those with a zone."""
        for b in rows_in(batches, 1):
            row = b.to_pylist()[0]
            lens, data = np.array(row["lens"], np.int64), _unpack(row["data"])
            has, zones = np.zeros(len(lens), bool), []
            for d in depths:
                k = d.block(row)
                zone = d.zone(row, k)
                has |= np.add.reduceat(np.append(zone, False).astype(np.int64), k.begin[:-1]) * (k.lens > 0) > 0
                zones.append((k.lens, zone))
            for alive in (False, True):
                docs_of = np.flatnonzero(has == alive)
                if not len(docs_of):
                    continue
                mask = np.repeat(has == alive, lens)
                left = [_pack(np.packbits(zone[np.repeat(has, n)])) for n, zone in zones] if alive else None
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([[row["ids"][i] for i in docs_of]], b.schema.field(1).type), pa.array([lens[docs_of].tolist()], pa.list_(pa.int64())),
                     pa.array([_pack(data[mask])], pa.binary()), pa.array([left], pa.list_(pa.binary()))],
                    names=["block", "ids", "lens", "data", "zones"])

    work = materialize(answered(blocks, one).mapInArrow(part, f"block bigint, ids {ids_type}, lens array<bigint>, data binary, zones array<binary>"), "blocks-left")
    open_ = work.where("zones is not null")
    two = _ask(open_, lambda row: [d.string_names(row) for d in depths], "<u8", "2")
    three = _ask(answered(open_, two), lambda row: [d.class_names(row)[0] for d in depths], "<u8", "3")
    four = _ask(answered(open_, two, three), lambda row: [d.suffix_names(row)[0] for d in depths], "<u8", "4")

    def result(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches, 1):
            row = b.to_pylist()[0]
            lens, data = np.array(row["lens"], np.int64), _unpack(row["data"])
            is_open = row.get("zones") is not None
            gone = depths[0].covered(row, depths[0].block(row)) if is_open else np.zeros(len(data), bool)
            begin = np.concatenate([[0], np.cumsum(lens)])
            spans, kept = [], []
            for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
                own = gone[s:e]
                step = np.flatnonzero(np.diff(own, prepend=False, append=False)) if len(own) else np.empty(0, int)
                spans.append([{"from": int(x), "to": int(y)} for x, y in zip(step[::2], step[1::2])])
                kept.append(data[s:e][~own].tobytes())
            out = {id_col: pa.array(row["ids"], b.schema.field("ids").type.value_type), "n_bytes": pa.array(lens),
                   "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), "kept": pa.array(kept, pa.binary())}
            if passage_words is not None:
                shared = np.zeros(len(lens), np.int64)
                if is_open:
                    k = depths[1].block(row)
                    shared = np.diff(np.concatenate([[0], np.cumsum(depths[1].covered(row, k))])[k.begin])
                out["n_passage_words"] = pa.array(shared)
            yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    schema = f"`{id_col}` {ids_type[6:-1]}, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary" + ", n_passage_words bigint" * (passage_words is not None)
    settled = work.where("zones is null").select("block", "ids", "lens", "data")
    return settled.mapInArrow(result, schema).unionByName(answered(open_, two, three, four).mapInArrow(result, schema))
