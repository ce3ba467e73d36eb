"""Merkle manifest of a dataset with incremental witnesses.

Each row is a leaf; the leaves of a source stand by id in a tree of three-way
runs, and the roots of the sources stand by source in another one.  A leaf's
witness is what a holder of the row needs to recompute the root: its siblings,
level by level.

Rows are numbered inside their source and cut into aligned blocks of 3^LEVELS,
so a source with a third of all rows is many blocks.  A task appends the nodes
of its block one after the other (``Witnesses``): a node opens a subtree whose
members' witnesses are partial; when the siblings of a run are complete, each
member's witnesses gain them and the parent is appended one level up.  The root
of a block is a node of the next tier, which appends block roots in the same way,
until a source has one node; the sources' roots are one more such sequence.
Witnesses of a tier join on (source, block) with what the next tier gave to the
block, so each row carries its own levels once and no tree is held anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import row_number_by
from ..session import materialize

#: Levels of the tree that a task builds at a time: blocks of 3^8 = 6561 nodes.
LEVELS = 8
RUN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def parent_of(digests: Iterable[bytes]) -> bytes:
    """The node over a run: sha256 of the digests as joined hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Witnesses:
    """Aligned append of nodes, with a growing witness for each.

    ``open[l]`` holds the nodes of level l whose run isn't complete, each with
    the range of appended nodes below it.
    """

    def __init__(self):
        self.partial: list[bytearray] = []
        self.open: list[list[tuple[bytes, int, int]]] = [[]]

    def append(self, digest: bytes) -> None:
        self.partial.append(bytearray())
        self._add(0, digest, len(self.partial) - 1, len(self.partial))

    def _add(self, level: int, digest: bytes, first: int, last: int) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        run.append((digest, first, last))
        if len(run) == RUN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for k, (_, first, last) in enumerate(run):
            siblings = b"".join(d for j, (d, _, _) in enumerate(run) if j != k)
            for i in range(first, last):
                self.partial[i] += siblings
        self._add(level + 1, parent_of(d for d, _, _ in run), run[0][1], run[-1][2])

    def close(self, levels: int | None) -> tuple[bytes, int]:
        """Ends the block: (its root, its levels).  With ``levels`` short runs
        close up to that level, as in a block that others follow or precede;
        without, until one node remains."""
        level = 0
        while level < levels if levels is not None else level < len(self.open) - 1 or len(self.open[level]) > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0], level


def fold(digest: bytes, at: int, of: int, witness: bytes, start: int = 0) -> tuple[bytes, int]:
    """(root, end of what was read) from node ``at`` of ``of`` and its witness."""
    while of > 1:
        place, width = at % RUN, min(RUN, of - at + at % RUN)
        run = [witness[start + 32 * k: start + 32 * (k + 1)] for k in range(width - 1)]
        start += 32 * (width - 1)
        digest = parent_of([*run[:place], digest, *run[place:]])
        at, of = at // RUN, -(-of // RUN)
    return digest, start


NODE = "_g long, _at long, _of long, _d binary"


def _tier(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """One tier of (_g, _at, _of, _d): (_g, _at, _w) with the witness of each
    node in its block, and the blocks' roots as nodes of the next tier."""
    size = RUN**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        state = Witnesses()
        for d in table["_d"].to_pylist():
            state.append(d)
        g, at, of = (table[c][0].as_py() for c in ("_g", "_at", "_of"))
        root, _ = state.close(levels if of > size else None)
        n = table.num_rows
        return pa.table({"_g": pa.array([g] * (n + 1), pa.int64()), "_at": pa.concat_arrays([table["_at"].combine_chunks(), pa.array([at // size], pa.int64())]),
                         "_of": pa.array([None] * n + [-(-of // size)], pa.int64()), "_d": pa.array([None] * n + [root], pa.binary()),
                         "_w": pa.array([bytes(w) for w in state.partial] + [None], pa.binary())})

    keyed = nodes.groupBy("_g", F.expr(f"_at div {size}").alias("_b"))
    out = materialize(keyed.applyInArrow(run, f"{NODE}, _w binary"), "manifest-tier")
    return out.where("_d is null").select("_g", "_at", "_w"), out.where("_d is not null").select("_g", "_at", "_of", "_d")


def witnesses(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Nodes (_g, _at, _of, _d) -> their whole witnesses (_g, _at, _w), and the
    root of each group (_g, _root).  Tiers go on while a group has two blocks."""
    size, tiers = RUN**levels, []
    while True:
        tier, nodes = _tier(nodes, levels)
        tiers.append(tier)
        if nodes.where("_of > 1").isEmpty():
            break
    out = tiers.pop()
    while tiers:
        above = out.select(F.col("_g").alias("_ag"), F.col("_at").alias("_ab"), F.col("_w").alias("_aw"))
        below = tiers.pop()
        out = below.join(above, (F.col("_g") == F.col("_ag")) & (F.expr(f"_at div {size}") == F.col("_ab")), "left").select(
            "_g", "_at", F.concat("_w", F.coalesce("_aw", F.lit(b""))).alias("_w"))
    return out, nodes.select("_g", F.col("_d").alias("_root"))


def leaf_text(columns: Iterable[str | Column]) -> Column:
    """What a leaf hashes: each value's UTF-8 length, a colon and the value, or a dash for a null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[part((F.col(c) if isinstance(c, str) else c).cast("string")) for c in columns])


def digest_of(columns: Iterable[str | Column]) -> Column:
    return F.unhex(F.sha2(leaf_text(columns).cast("binary"), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: Iterable[str] = COLUMNS,
             levels: int = LEVELS, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: _id, _leaf (digest over ``columns``), place
    and size of its source (_at, _of), _subroot, place and number of the source
    (_s, _sources), _root, and the two parts of its witness, _w up to the
    subroot and _sw from there to the root (packed 32-byte digests); ``extra``
    adds columns made from ``docs``.

    Leaves stand by id (null first), rows that share an id by digest; a null
    source is a source of its own, the first.  One row is its own subroot, one
    source its own root, with empty witnesses.  An empty table gives no rows.
    """
    extra = extra or {}
    leaves = materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), digest_of(columns).alias("_leaf"),
                                     F.monotonically_increasing_id().alias("_tie"), *[c.alias(n) for n, c in extra.items()]), "manifest-leaves")
    # The last key spreads equal rows over ranges; their order makes no difference.
    placed = row_number_by(leaves, [F.col("_id").asc_nulls_first(), F.col("_leaf").asc(), F.col("_tie").asc()], by=["_source"])
    sources = row_number_by(leaves.groupBy("_source").agg(F.count(F.lit(1)).alias("_of")), [F.col("_source").asc_nulls_first()], out="_s")
    sources = materialize(sources.withColumn("_s", F.col("_s") - 1), "manifest-sources", 1)
    n = sources.count()
    by = sources.select("_s", "_of", F.col("_source").alias("_by"))
    rows = materialize(placed.join(by, F.col("_source").eqNullSafe(F.col("_by"))).select(
        F.col("_s").alias("_g"), (F.col("rn") - 1).alias("_at"), "_of", "_id", "_leaf", *extra), "manifest-rows")
    if not n:
        empty = F.lit(None)
        return rows.select("_id", "_leaf", "_at", "_of", empty.cast("binary").alias("_subroot"), F.col("_g").alias("_s"), F.lit(0).alias("_sources"),
                           *[empty.cast("binary").alias(c) for c in ("_root", "_w", "_sw")], *extra)
    own, subroots = witnesses(rows.select("_g", "_at", "_of", F.col("_leaf").alias("_d")), levels)
    subroots = materialize(subroots, "manifest-subroots", 1)
    upper, root = witnesses(subroots.select(F.lit(0).cast("long").alias("_g"), F.col("_g").alias("_at"), F.lit(n).cast("long").alias("_of"),
                                            F.col("_root").alias("_d")), levels)
    root = root.select("_root").first()[0]
    tops = subroots.withColumnRenamed("_root", "_subroot").join(upper.select(F.col("_at").alias("_g"), F.col("_w").alias("_sw")), "_g")
    return (rows.join(own, ["_g", "_at"]).join(tops, "_g")
            .select("_id", "_leaf", "_at", "_of", "_subroot", F.col("_g").alias("_s"), F.lit(n).alias("_sources"),
                    F.lit(bytes(root)).alias("_root"), "_w", "_sw", *extra))


FOLDED = "_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(rows: DataFrame, leaf_col: str = "_leaf") -> DataFrame:
    """Rows of ``manifest`` -> _id, leaf, subroot, root, proof_sha256 (sha256 of
    the witness as hex text), folded_root (recomputed from ``leaf_col``, which
    may differ from the leaf, and the witness) and verified."""
    rows = rows.select("_id", "_leaf", F.col(leaf_col).alias("_claim"), "_at", "_of", "_s", "_sources", "_w", "_sw", "_subroot", "_root")
    schema = FOLDED.format(rows.schema["_id"].dataType.simpleString())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proof, folded, same = [], [], []
            for _, _, claim, at, of, s, n, w, sw, _, root in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                sub, _ = fold(claim, at, of, w)
                top, _ = fold(sub, s, n, sw)
                proof.append(hashlib.sha256((w.hex() + sw.hex()).encode()).hexdigest())
                folded.append(top.hex())
                same.append(top == root)
            text = lambda c: pa.array([x.hex() for x in b.column(c).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_id"), text("_leaf"), text("_subroot"), text("_root"), pa.array(proof, pa.string()),
                                              pa.array(folded, pa.string()), pa.array(same, pa.bool_())],
                                             names=["_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(run, schema)


_CRC = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))),
            lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::UBIGINT)),
                                     lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))))"""


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _tree(name: str, nodes: str) -> str:
    """The nodes (g, level, pos, h) of all levels over the leaves ``nodes``."""
    return f"""{name} AS (
  SELECT g, 0 AS level, pos, n, h FROM {nodes}
  UNION ALL
  SELECT g, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // 3)"""


ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, sha256({' || '.join(_field(c) for c in COLUMNS)}) AS leaf,
         CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 2 = 0
              THEN sha256({' || '.join(_field("replace(text, chr(10), '')" if c == "text" else c) for c in COLUMNS)}) END AS other
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM docs),
lower_leaves AS (SELECT g, pos, n, leaf AS h FROM placed),
{_tree('lower', 'lower_leaves')},
subroots AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM lower WHERE n = 1),
{_tree('upper', 'subroots')},
steps AS (
  SELECT p.doc_id, p.g, p.pos, l.level AS step, string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos < p.pos // CAST(pow(3, l.level) AS BIGINT)) AS before,
         string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos > p.pos // CAST(pow(3, l.level) AS BIGINT)) AS after
  FROM placed p JOIN lower l ON l.g = p.g AND l.n > 1 AND l.pos // 3 = p.pos // CAST(pow(3, l.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.g, p.pos, 100 + u.level, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < p.g // CAST(pow(3, u.level) AS BIGINT)),
         string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > p.g // CAST(pow(3, u.level) AS BIGINT))
  FROM placed p JOIN upper u ON u.n > 1 AND u.pos // 3 = p.g // CAST(pow(3, u.level + 1) AS BIGINT) GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY step) AS k FROM steps),
folds AS (
  SELECT g, pos, 0 AS k, coalesce(other, leaf) AS h FROM placed
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(coalesce(s.before, '') || f.h || coalesce(s.after, ''))
  FROM folds f JOIN numbered s ON s.g = f.g AND s.pos = f.pos AND s.k = f.k + 1),
folded AS (SELECT g, pos, arg_max(h, k) AS h FROM folds GROUP BY g, pos),
proofs AS (SELECT g, pos, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY k) AS w FROM numbered GROUP BY g, pos)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(w, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON s.pos = p.g JOIN (SELECT h FROM upper WHERE n = 1) r ON true
JOIN folded f ON f.g = p.g AND f.pos = p.pos LEFT JOIN proofs w ON w.g = p.g AND w.pos = p.pos
"""
