"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases,
with DataFrame operations only.

A paragraph is a line, and ``SECTION`` paragraphs make a section.  The leaves
below a paragraph are its phrases, runs of ``PHRASE`` words between single
spaces, so that an edit inside a long paragraph is located too.  A leaf is the
hash of its text, a paragraph that of its leaves' hashes, a section that of its
paragraphs', and the root that of its sections'.  Nothing of the text is left
out, so roots test equality.  The fingerprint is written out, with hashes below
the root cut to a few digits, as

    root|section:paragraph=leaf,leaf;paragraph=leaf|section:...

and comparing two of them from the root down leads to the branches that an edit
touched.  The likeness of two fingerprints is the Dice coefficient of their
leaves with repeats: a leaf that stands three times in one and twice in the
other counts as two common leaves, so repetitive texts keep their weight.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_partitions

SECTION = 8  # paragraphs in a section
PHRASE = 5   # words in a leaf
ROOT_HEX, SECTION_HEX, PARAGRAPH_HEX, LEAF_HEX = 32, 16, 12, 8
_NULL_SHARDS = 64


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


#: Cut an array-free way, in one pass over the text: with a line break (a space)
#: appended, the sections of a text (the phrases of a paragraph) each end at one.
_SECTIONS = rf"((?:[^\n]*\n){{0,{SECTION - 1}}}[^\n]*)\n"
_PHRASES = rf"([^ ]*(?: [^ ]*){{0,{PHRASE - 1}}}) "


def _numbered(leaves: Column) -> Column:
    """The leaves, each with the number of its occurrence, so that a plain
    intersection of two such arrays is that of multisets.  Linear: runs of equal
    leaves are cut from the sorted array."""
    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda at: F.flatten(F.transform(at, lambda b, k: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s)) - b), lambda n: F.concat(F.get(s, b), F.lit(":"), n.cast("string"))))))[0]

    # An array of one binds the sorted leaves (and the starts) to a variable, so they are made once.
    return F.transform(F.array(F.array_sort(leaves)), of)[0]


def _leaf_hashes(text: Column) -> Column:
    """array (sections) of arrays (paragraphs) of arrays (leaf hashes, whole)."""
    sections = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(_SECTIONS), F.lit(1))
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(
        F.regexp_extract_all(F.concat(p, F.lit(" ")), F.lit(_PHRASES), F.lit(1)), _md5)))


def _with_tree_of(df: DataFrame, leaves: str, out: str) -> DataFrame:
    """``df`` with the tree over a column of leaf hashes."""
    paragraphs, sections = f"_{out}_paragraphs", f"_{out}_sections"
    cut = lambda hs: F.transform(hs, lambda h: F.substring(h, 1, LEAF_HEX))
    named = F.transform(F.col(leaves), lambda ps: F.transform(ps, lambda hs: F.struct(
        _md5(F.array_join(hs, "")).alias("h"), F.array_join(cut(hs), ",").alias("below"))))
    nodes = F.transform(F.col(paragraphs), lambda ps: F.struct(
        _md5(F.array_join(F.transform(ps, lambda p: p["h"]), "")).alias("h"),
        F.array_join(F.transform(ps, lambda p: F.concat(F.substring(p["h"], 1, PARAGRAPH_HEX), F.lit("="), p["below"])), ";").alias("below")))
    root = _md5(F.array_join(F.transform(F.col(sections), lambda s: s["h"]), ""))
    body = F.array_join(F.transform(F.col(sections), lambda s: F.concat(F.substring(s["h"], 1, SECTION_HEX), F.lit(":"), s["below"])), "|")
    return (df.withColumn(paragraphs, named).withColumn(sections, nodes)
            .withColumn(out, F.struct(F.concat(root, F.lit("|"), body).alias("fp"),
                                      _numbered(cut(F.flatten(F.flatten(F.col(leaves))))).alias("leaves")))
            .drop(paragraphs, sections))


def with_tree(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: struct<fp: the fingerprint string, leaves: the
    leaf hashes (cut), each with the number of its occurrence>.  A null text counts as empty, which is a tree
    of one empty leaf.  A column of that name is replaced."""
    return _with_tree_of(df.withColumn("_own_leaves", _leaf_hashes(F.coalesce(F.col(text_col), F.lit("")))), "_own_leaves", out).drop("_own_leaves")


def likeness(a: Column, b: Column) -> Column:
    """Of two trees: 0 to 1, 1 for equal roots."""
    x, y = a["leaves"], b["leaves"]
    dice = F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(F.substring(a["fp"], 1, ROOT_HEX) == F.substring(b["fp"], 1, ROOT_HEX), F.lit(1.0)).otherwise(dice)


def _shard(id_col: Column, tie: Column, cuts: list[int]) -> Column:
    """The number of the range that a row falls in, ascending as (id descending
    with nulls last, tie descending).  The bounds are searched in two steps, so
    a row compares with some 2 sqrt(their number) of them.  Rows without an id,
    which may be many, are spread by their tie hash, and so are those of an id
    that is several of the ``cuts``, over as many ranges."""
    bounds = sorted(set(cuts), reverse=True) or [0]
    hot = {v: n for v, n in Counter(cuts).items() if n > 1}
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k: k + step] for k in range(0, len(bounds), step)]
    above = lambda xs: F.size(F.filter(xs, lambda v: v > id_col))
    # As JSON the bounds are one constant of the plan each, not an expression for every number.
    whole = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps([*groups, []])), "array<array<bigint>>")
    by_id = above(whole) * F.lit(step + 1) + above(F.get(fine, above(whole)))
    last = (len(groups) + 1) * (step + 1)
    if hot:
        # A bound is the least id of its range: its rows come after the others there.
        ids, parts = (F.from_json(F.lit(json.dumps(list(x))), "array<bigint>") for x in (hot, hot.values()))
        n = F.coalesce(F.get(parts, (F.array_position(ids, id_col) - 1).cast("int")), F.lit(0).cast("long"))
        stride = max(hot.values()) + 1
        by_id = by_id * F.lit(stride) + n - F.shiftright((F.shiftright(tie, 48) + F.lit(1 << 15)) * n, 16)
        last *= stride
    by_tie = F.lit(last + _NULL_SHARDS - 1) - (F.shiftright(tie, 58) + F.lit(_NULL_SHARDS // 2)).cast("int")
    return F.when(id_col.isNull(), by_tie).otherwise(by_id).cast("int")


def _in_ranges(src: DataFrame, want: int) -> DataFrame:
    """``src`` with ``_shard``: some ``want`` ranges of about equal numbers of rows."""
    cuts = src.agg(F.percentile_approx("_id", [k / want for k in range(1, want)], 20 * want)).first()[0] or []
    return src.withColumn("_shard", _shard(F.col("_id"), F.col("_tie"), cuts))


def with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text (null: empty), n_chars, tree, edited, edited_tree, next_tree.

    The next document is the one after this by descending id (null ids last,
    equal ids by a hash of the text), after the last the first; the edited text
    has the last floor(n_chars / 3) code points replaced by the next one's first
    as many, or all it has.

    Texts are shuffled once, by ranges of the id (their bounds, from approximate
    percentiles, are all that the driver sees).  The last row of a range needs
    the first of the range after it: that row is added to the range as a guard
    and dropped again.
    """
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    src = src.withColumn("_tie", F.xxhash64("_text"))
    rows = _in_ranges(src, 4 * shuffle_partitions(docs.sparkSession))
    # The first row of each range: at most one per range comes to the driver, an id and a hash.
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in rows.groupBy("_shard").agg(F.max(F.struct("_id", "_tie"))).collect())
    guards = [(shard, *firsts[(k + 1) % len(firsts)][1:]) for k, (shard, _, _) in enumerate(firsts)]
    ends = docs.sparkSession.createDataFrame(guards, "_for int, _gid long, _gtie long")
    found = (src.join(F.broadcast(ends), F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_tie") == F.col("_gtie")))
             .groupBy("_for").agg(F.max("_text").alias("_text")))
    found = found.select(F.lit(None).cast("long").alias("_id"), "_text", F.lit(None).cast("long").alias("_tie"),
                         F.col("_for").alias("_shard"), F.lit(1).alias("_guard"))
    w = Window.partitionBy("_shard").orderBy("_guard", F.col("_id").desc_nulls_last(), F.col("_tie").desc())
    laid = rows.withColumn("_guard", F.lit(0)).unionByName(found)
    n = F.length("_text").cast("long")
    cut = F.floor(n / 3).cast("int")
    out = laid.withColumns({"_kept": F.substring(F.col("_text"), F.lit(1), (n - cut).cast("int")),
                            "_new": F.coalesce(F.substring(F.lead("_text").over(w), F.lit(1), cut), F.lit(""))})
    # The sections that end before the edit keep their hashes; only what follows them is hashed again.
    breaks = (F.length("_kept") - F.length(F.replace(F.col("_kept"), F.lit("\n"), F.lit("")))).cast("int")
    same = F.floor(breaks / SECTION).cast("int")
    # From the right, the paragraphs of the unfinished section and the one that the edit cuts.
    rest = F.call_function("substring_index", F.col("_kept"), F.lit("\n"), -(breaks - same * SECTION) - 1)
    out = out.withColumn("_leaves", _leaf_hashes(F.col("_text")))
    out = out.withColumn("_edited_leaves", F.concat(F.slice("_leaves", F.lit(1), same), _leaf_hashes(F.concat(rest, F.col("_new")))))
    out = _with_tree_of(_with_tree_of(out, "_leaves", "tree"), "_edited_leaves", "edited_tree").drop("_leaves", "_edited_leaves")
    out = out.withColumn("next_tree", F.lead("tree").over(w)).where("_guard = 0")
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), n.alias("n_chars"), "tree",
                      F.concat("_kept", "_new").alias("edited"), "edited_tree", "next_tree")


def edit_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Null texts count as empty; an
    empty table gives no rows; a lone document is its own next."""
    t = with_edit(docs, id_col, text_col)
    return t.select(id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    F.col("tree.fp").alias("fingerprint"), F.col("edited_tree.fp").alias("edited_fingerprint"),
                    likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
                    likeness(F.col("tree"), F.col("next_tree")).alias("near_next"))


def _sql_tree(t: str) -> str:
    return f"""
      SELECT *, md5(array_to_string(list_transform(sections, lambda s: s.h), '')) || '|' ||
             array_to_string(list_transform(sections, lambda s: substr(s.h, 1, {SECTION_HEX}) || ':' || s.below), '|') AS fp,
             list_transform([list_sort(list_transform(flatten(leaves), lambda h: substr(h, 1, {LEAF_HEX})))],
                     lambda hs: list_transform(hs, lambda h, i: h || ':' || (i - list_position(hs, h) + 1)))[1] AS cut
      FROM (
        SELECT *, list_transform(range(0, len(paragraphs), {SECTION}), lambda s: {{
            'h': md5(array_to_string(list_transform(list_slice(paragraphs, s + 1, s + {SECTION}), lambda p: p.h), '')),
            'below': array_to_string(list_transform(list_slice(paragraphs, s + 1, s + {SECTION}), lambda p: substr(p.h, 1, {PARAGRAPH_HEX}) || '=' || p.below), ';')}}) AS sections
        FROM (
          SELECT *, list_transform(leaves, lambda hs: {{'h': md5(array_to_string(hs, '')),
                 'below': array_to_string(list_transform(hs, lambda h: substr(h, 1, {LEAF_HEX})), ',')}}) AS paragraphs
          FROM (
            SELECT *, list_transform(string_split({t}, chr(10)), lambda p: list_transform(range(0, greatest(len(string_split(p, ' ')), 1), {PHRASE}),
                   lambda s: md5(array_to_string(list_slice(string_split(p, ' '), s + 1, s + {PHRASE}), ' ')))) AS leaves
            FROM edits)))"""


ORACLE = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
edits AS (
  SELECT doc_id, t, length(t) AS n, nid,
         substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) AS e
  FROM (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid
        FROM own WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
a AS ({_sql_tree('t')}),
b AS ({_sql_tree('e')})
SELECT a.doc_id, CAST(a.n AS BIGINT) AS n_chars, sha256(a.e) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       CASE WHEN a.fp[1:{ROOT_HEX}] = b.fp[1:{ROOT_HEX}] THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.cut, b.cut)) / (len(a.cut) + len(b.cut)) END AS near_edited,
       CASE WHEN a.fp[1:{ROOT_HEX}] = c.fp[1:{ROOT_HEX}] THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.cut, c.cut)) / (len(a.cut) + len(c.cut)) END AS near_next
FROM a JOIN b USING (doc_id) JOIN a AS c ON c.doc_id = a.nid
"""
