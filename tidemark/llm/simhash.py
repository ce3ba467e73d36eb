"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint bit is 1 when it is set in over half of the shingle hashes.  Two
fingerprints link when they differ in at most ``radius`` bits.  The search is
exact: the bit positions are labelled with non-zero vectors m(i) of F2^(r+1),
and table v (one for every non-zero v) masks out the positions with
<m(i), v> = 1.  The positions in which a pair differs put at most r linear
conditions on v, so some non-zero v fulfils them all, and the pair agrees on
everything that table keeps: every pair within the radius collides in some
table, with no probability of a miss.

Inside a bucket no pairs are formed.  Two fingerprints within 2h bits have a
midpoint within h bits of both, so the fingerprints of buckets with two members
or more emit the strings that flip at most h of the table's *masked* bits, and
equal strings link.  A string is reached by at most 1 + 64 fingerprints (h = 1),
all within the radius of each other, so groups stay bounded and linking them to
their least member loses and invents no link.  Copies are grouped before all
this: only distinct fingerprints are searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._common import free_names, rows_in, shuffle_partitions, utf8
from .components import components

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; the whole
    sequence when it is shorter; none for a text without words."""
    words = text.translate(_LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D
    n = len(words)
    if n == 0:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([h(joined, seed)], "<u8")
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = [h(joined[s:e], seed) for s, e in zip(start[: n - shingle + 1].tolist(), end[shingle - 1:].tolist())]
    return np.array(out, "<u8")


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at: at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42,
                     out: str = "fp") -> DataFrame:
    """``docs`` with ``out``: the fingerprint as a signed 64-bit number.  Rows
    stay where they are.  Null or wordless text gives 0.  A column already
    named ``out`` is replaced."""
    src = docs.drop(out)
    schema = src.select("*", F.lit(0).cast("long").alias(out)).schema
    at = src.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches):
            fps = [majority_bits(shingle_hashes(utf8(t), shingle, seed)) for t in b.column(at).to_pylist()]
            col = pa.array(np.array(fps, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return src.mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """The bits that each of the 2^(radius+1)-1 tables masks out."""
    top = 1 << (radius + 1)
    label = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (label[i] & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of
    the relation "at most ``radius`` bits apart".  ``radius`` is 0 or 2."""
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if radius != 2:
        raise ValueError("radius must be 0 or 2: midpoints are searched one flip away")
    gone = masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(~m & (2**64 - 1)))).alias("key"))
                       for t, m in enumerate(gone)])
    keyed = fps.select("fp", F.inline(tables))
    full = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    # As a table of its own: both sides of the join then come from plain shuffles, whose hot partitions AQE can split.
    full = materialize(full, "simhash-buckets", shuffle_partitions(fps.sparkSession) // 8)
    met = keyed.join(full, ["t", "key"], "left_semi")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if m >> i & 1]) for m in gone])
    near = met.select("fp", F.explode(flips[F.col("t")]).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    stars = near.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 each
    return stars.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").distinct()


def simhash_components(rows: DataFrame, id_col: str, radius: int = 2) -> DataFrame:
    """Rows (id_col, fp) -> (fp, component): the least id of the component that
    each distinct fingerprint belongs to (ids that are null don't count; null
    when a component has no other)."""
    first = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-fps",
                        shuffle_partitions(rows.sparkSession) // 8)  # a few bytes a row beside the texts that shuffles are sized for
    tree = components(fingerprint_links(first, radius))
    few = shuffle_partitions(rows.sparkSession) // 8
    placed = materialize(first.join(tree.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-placed", few)
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("component")), "simhash-least", few)
    return materialize(placed.join(least, "root").select("fp", "component"), "simhash-components", few)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 2) -> DataFrame:
    """One row per input row: id_col, ``fingerprint`` (16 hex digits) and
    ``component_id``, the least id reachable over links of at most ``radius``
    differing bits (its own included).

    Null, empty and wordless texts have fingerprint zero and link like others.
    Rows with equal ids or texts each keep their row.  Other columns are not
    read.  An empty table gives no rows.
    """
    fps = materialize(add_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")),
                                       "_text", shingle).select("_id", "fp"), "simhash-docs")
    comp = simhash_components(fps, "_id", radius)
    return fps.join(comp, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             radius: int = 2) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the one of
    least id (null ids last), of equal ids the one that the scan numbered first."""
    cols, (fp, row) = docs.columns, free_names(docs, "_fp", "_row")
    tagged = materialize(add_fingerprints(docs, text_col, shingle, out=fp)
                         .withColumn(row, F.monotonically_increasing_id()), "simhash-tagged")
    rows = tagged.select(F.col(fp).alias("fp"),
                         F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("_row")).alias("_place"))
    best = simhash_components(rows, "_place", radius).select(F.col("component._row").alias(row)).distinct()
    return tagged.join(best, row, "left_semi").select(*cols)
