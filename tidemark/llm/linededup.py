"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Every position (document, line number) stands for the suffix of its document
that begins there.  Lines that stand at two positions or more are ranked; a round
ranks the suffixes that still share their rank by the ranks L, 2L, ... 7L lines
further on, which is three doublings in one sort, and goes on with 8L, until each
suffix is alone or equal to another up to the end of its document.  A rank is the
number of suffixes before the group, so ranks of settled suffixes stay valid while
others are refined, and documents whose suffixes are all settled take no further
part.  A line that occurs once ends what its suffix can share, and such suffixes
come last in their group, by position; so only repeated lines take part at all.

Longest common prefixes of neighbours in suffix order: equal suffixes share all
of their lines; two that parted in a round share as many lines as the ranks
equal in it say, exactly in the first round and within L lines in a later one.
There, where the lines before both agree the prefix is one less than that of the
position before, and the others, few, are compared line by line between the bounds.
The intervals of the suffix order with common prefixes of ``min_lines`` or more
are the repeats; the first position of an interval is their source, and what the
others cover is deleted.

With ``long_words`` a run qualifies by its content too: a single line of at
least so many words, or one that is all of its document, needs no neighbour.

A line or passage that a third of all documents hold is spread over ranges of
(rank, ranks ahead, position), each numbered in itself; what a range needs of the
others is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._common import WORD, shuffle_partitions

_KEY = ["_id", "_th"]


def _at() -> Column:
    """A position; rows equal in id and text are one document."""
    return F.struct("_id", "_th", "_pos")


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``name``, the first position, of those ``by`` that stand at two positions or more."""
    groups = rows.groupBy(*by).agg(F.min(_at()).alias("name"), F.max(_at()).alias("_last")).where("name <> _last")
    # As a table of its own: both sides of the join then come from plain shuffles, whose hot partitions AQE can split.
    return materialize(groups.select(*by, "name"), "line-names", shuffle_partitions(rows.sparkSession) // 4)


def _named(rows: DataFrame, by: list[str], shared: DataFrame | None = None) -> DataFrame:
    """Positions with ``name``: the first position of equal ``by``; those that are alone go."""
    return rows.join(_shared(rows, by) if shared is None else shared, by).select(*_KEY, "_pos", "name")


_UNIQUE = (1 << 62)  # in place of a rank: a line that occurs once
_END = -1
_BLOCK = 1 << 14     # entries of the suffix order in a block
_TIMES = 8           # a round takes three doublings at once
_PLACE = [*_KEY, "_pos"]


def _by_document():
    return Window.partitionBy(*_KEY).orderBy("_pos")


def _in_ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """A table of ``rows`` in ranges of ``order``, which tells all rows apart; ``_range`` is the range's place."""
    return materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def _inside(order: list[str]):
    return Window.partitionBy("_range").orderBy(*order)


def _ranges():
    """Over one row for each range."""
    return Window.orderBy("_range")


def _earlier():
    return _ranges().rowsBetween(Window.unboundedPreceding, -1)


def _offset() -> Column:
    return F.coalesce(F.sum("_count").over(_earlier()), F.lit(0)).alias("_offset")


def _line_ranks(rows: DataFrame) -> DataFrame:
    """``_line`` and ``_rank``, the number of rows with a lesser line; counted before the shuffle."""
    groups = _in_ranges(rows.groupBy("_line").agg(F.count(F.lit(1)).alias("_members")), ["_line"], "line-groups")
    ends = groups.groupBy("_range").agg(F.sum("_members").alias("_count")).select("_range", _offset())
    before = F.coalesce(F.sum("_members").over(_inside(["_line"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("_before", before).join(ends, "_range").select("_line", (F.col("_before") + F.col("_offset")).alias("_rank"))


def _parting(x: Column, y: Column, length: int) -> tuple[Column, Column]:
    """The least and (one more than) the most lines shared by suffixes of one
    rank, from the ranks ``length``, 2 ``length``, ... lines further on."""
    k = F.array_position(F.zip_with(x, y, lambda a, b: (a != b) | (a == _UNIQUE)), True)
    low = F.lit(length).cast("long") * k
    a, b = F.get(x, (k - 1).cast("int")), F.get(y, (k - 1).cast("int"))
    exact = F.lit(length == 1) | (F.least(a, b) == _END) | (F.greatest(a, b) == _UNIQUE)
    return low, low + F.when(exact, F.lit(1)).otherwise(F.lit(length))


def _refined(sorted_: DataFrame, length: int) -> DataFrame:
    """A round: the rows of ``sorted_``, laid out by rank, ``_nexts`` and place,
    with the ranks of suffixes ``_TIMES`` as long.  A group that spans ranges
    takes its start from the range in which it begins."""
    inside = _inside(["_rank", "_nexts", *_PLACE])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct("_rank", "_nexts")
    differs = lambda a, b: (a != b) | F.array_contains(b["_nexts"], F.lit(_UNIQUE))
    low, high = _parting(F.col("_prev._nexts"), F.col("_nexts"), length)
    begun = F.struct(F.col("_nth").alias("at"), low.alias("low"), high.alias("high"))
    rows = sorted_.withColumns({"_nth": F.row_number().over(inside).cast("long"), "_prev": F.lag(key).over(inside), "_follow": F.lead(key).over(inside)})
    rows = rows.withColumns({"_group": F.max(F.when(differs(F.col("_prev"), key), begun)).over(so_far),
                             "_ranked": F.max(F.when(F.col("_prev._rank") != F.col("_rank"), F.col("_nth"))).over(so_far),
                             "_several": ~differs(key, F.col("_follow"))})
    rows = materialize(rows.drop("_prev", "_follow"), "suffix-groups")
    ends = rows.groupBy("_range").agg(F.max("_nth").alias("_count"), F.min_by(key, "_nth").alias("_first"), F.max_by(key, "_nth").alias("_last"),
                                      F.max("_group").alias("_g"), F.max("_ranked").alias("_r"))
    ends = ends.select("*", _offset(), F.lag("_last").over(_ranges()).alias("_plast"), F.lead("_first").over(_ranges()).alias("_nfirst"))
    low, high = _parting(F.col("_plast._nexts"), F.col("_first._nexts"), length)
    shifted = lambda g: F.struct((g["at"] + F.col("_offset")).alias("at"), g["low"].alias("low"), g["high"].alias("high"))
    here = F.struct((F.col("_offset") + 1).alias("at"), low.alias("low"), high.alias("high"))
    ends = ends.withColumns({
        "_g0": F.when(F.coalesce(differs(F.col("_plast"), F.col("_first")), F.lit(True)), here),
        "_r0": F.when(F.coalesce(F.col("_plast._rank") != F.col("_first._rank"), F.lit(True)), F.col("_offset") + 1)})
    ends = ends.withColumns({"_g": F.coalesce(F.when(F.col("_g").isNotNull(), shifted(F.col("_g"))), F.col("_g0")), "_r": F.coalesce(F.col("_r") + F.col("_offset"), F.col("_r0"))})
    ends = ends.select("_range", "_offset", F.coalesce("_g0", F.last("_g", ignorenulls=True).over(_earlier())).alias("_g0"),
                       F.coalesce("_r0", F.last("_r", ignorenulls=True).over(_earlier())).alias("_r0"),
                       F.coalesce(~differs(F.col("_last"), F.col("_nfirst")), F.lit(False)).alias("_nsame"))
    rows = rows.join(ends, "_range")
    rows = rows.withColumns({"_group": F.coalesce(F.when(F.col("_group").isNotNull(), shifted(F.col("_group"))), F.col("_g0")),
                             "_ranked": F.coalesce(F.col("_ranked") + F.col("_offset"), F.col("_r0"))})
    several = F.coalesce("_several", "_nsame") | (F.col("_group.at") < F.col("_nth") + F.col("_offset"))
    split = F.col("_open") & (F.col("_group.at") > F.col("_ranked"))
    goes_on = F.element_at("_nexts", _TIMES - 1) >= 0
    return rows.select(*_PLACE, "_n", "_head", F.when(split, F.col("_rank") + F.col("_group.at") - F.col("_ranked")).otherwise(F.col("_rank")).alias("_rank"),
                       F.when(split, F.col("_group.low")).otherwise(F.col("_low")).alias("_low"),
                       F.when(split, F.col("_group.high")).otherwise(F.col("_high")).alias("_high"),
                       (F.col("_open") & several & goes_on).alias("_open"))


def suffix_ranks(lines: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Lines (_id, _th, _pos, _n, _line) -> (_id, _th, _pos, _n, _head, _rank,
    _low, _high) of the positions whose line occurs at another position too: the
    rank of the line and of the suffix, and the bounds, the upper one left out, of
    the lines shared with the suffixes of the next lesser rank.  Equal ranks are
    equal suffixes."""
    shared = _shared(lines, ["_line"]) if shared is None else shared
    rows = lines.join(shared.select("_line"), "_line").select(*_PLACE, "_n", "_line").distinct()
    state = rows.join(_line_ranks(rows), "_line").select(*_PLACE, "_n", F.col("_rank").alias("_head"), "_rank", F.lit(0).cast("long").alias("_low"),
                                                         F.lit(1).cast("long").alias("_high"), F.lit(True).alias("_open"))
    columns, done, length = state.columns[:-1], [], 1
    while True:
        w = _by_document()
        nexts = [F.when(F.col("_pos") + k * length >= F.col("_n"), F.lit(_END).cast("long")).otherwise(
            F.coalesce(F.first("_rank").over(w.rangeBetween(k * length, k * length)), F.lit(_UNIQUE))) for k in range(1, _TIMES)]
        # What follows a unique line tells nothing: the suffix differs from all others there.
        cut = F.array_position("_nexts", F.lit(_UNIQUE))
        nexts = state.withColumns({"_nexts": F.array(*nexts), "_active": F.max("_open").over(Window.partitionBy(*_KEY))})
        nexts = nexts.withColumn("_nexts", F.when(F.col("_open"), F.when(cut > 0, F.transform("_nexts", lambda x, k: F.when(k < cut, x).otherwise(F.lit(_END).cast("long"))))
                                                  .otherwise(F.col("_nexts"))).otherwise(F.array_repeat(F.lit(_END).cast("long"), _TIMES - 1)))
        laid = _in_ranges(nexts, ["_rank", "_nexts", *_PLACE], "suffix-ranges")
        done.append(laid.where("not _active").select(*columns))  # documents without a suffix to refine
        state, length = _refined(laid.where("_active").drop("_active"), length), _TIMES * length
        if state.where("_open").isEmpty():
            break
    for part in done:
        state = state.select(*columns).unionByName(part)
    return state.select(*columns)


def suffix_order(lines: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Lines -> (_id, _th, _pos, _at, _lcp): the suffix array over repeated lines.
    ``_at`` is the place in suffix order, from 1, and ``_lcp`` the number of lines
    shared with the suffix before it there."""
    ranks = suffix_ranks(lines, shared)
    ranks = ranks.withColumn("_before", F.first("_head").over(_by_document().rangeBetween(-1, -1)))
    order = _in_ranges(ranks, ["_rank", *_PLACE], "suffix-order")
    inside = _inside(["_rank", *_PLACE])
    row = F.struct(*_PLACE, "_n", "_rank", "_before")
    pairs = order.withColumns({"_nth": F.row_number().over(inside).cast("long"), "_p": F.lag(row).over(inside)})
    ends = order.groupBy("_range").agg(F.count(F.lit(1)).alias("_count"), F.max_by(row, F.struct("_rank", *_PLACE)).alias("_last"))
    ends = ends.select("_range", _offset(), F.lag("_last").over(_ranges()).alias("_plast"))
    pairs = pairs.join(ends, "_range").withColumns({"_at": F.col("_nth") + F.col("_offset"), "_p": F.coalesce("_p", "_plast")})
    left = (F.col("_n") - F.col("_pos")).cast("long")
    most = F.least(F.col("_high") - 1, left, (F.col("_p._n") - F.col("_p._pos")).cast("long"))
    pairs = pairs.withColumn("_most", most)
    known = (F.when(F.col("_p").isNull(), F.lit(0).cast("long")).when(F.col("_rank") == F.col("_p._rank"), left)
             .when(F.col("_most") <= F.col("_low"), F.col("_low")))
    pairs = pairs.withColumn("_lcp", known)
    pairs = pairs.withColumn("_carried", F.col("_lcp").isNull() & F.coalesce(F.col("_before") == F.col("_p._before"), F.lit(False)))
    pairs = materialize(pairs.select(*_PLACE, "_at", "_lcp", "_carried", "_p", "_low", "_most"), "suffix-neighbours")
    # Line by line between the bounds.
    steps = pairs.where("_lcp is null and not _carried").select("_at", *_PLACE, "_p", F.explode(F.sequence(F.col("_low"), F.col("_most") - 1)).alias("_k"))
    steps = steps.select("_at", "_k", *_KEY, (F.col("_pos") + F.col("_k")).alias("_pos"), F.col("_p._id").alias("_pid"), F.col("_p._th").alias("_pth"),
                         (F.col("_p._pos") + F.col("_k")).alias("_ppos"))
    one = order.select(*[F.col(c).alias(f"{c}1") for c in _PLACE], F.col("_head").alias("_a"))
    two = order.select(*[F.col(c).alias(f"{c}2") for c in _PLACE], F.col("_head").alias("_b"))
    same = steps.join(one, F.col("_id").eqNullSafe(F.col("_id1")) & (F.col("_th") == F.col("_th1")) & (F.col("_pos") == F.col("_pos1")), "left")
    same = same.join(two, F.col("_pid").eqNullSafe(F.col("_id2")) & (F.col("_pth") == F.col("_th2")) & (F.col("_ppos") == F.col("_pos2")), "left")
    parted = same.where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).groupBy("_at").agg(F.min("_k").alias("_parted"))
    pairs = pairs.join(parted, "_at", "left")
    lcp = F.when(F.col("_lcp").isNull() & ~F.col("_carried"), F.coalesce("_parted", "_most")).otherwise(F.col("_lcp"))
    pairs = pairs.select(*_PLACE, "_at", lcp.alias("_lcp"))
    # The prefix of a carried position is that of the last position compared, less the lines between.
    carried = F.last(F.col("_lcp") + F.col("_pos"), ignorenulls=True).over(_by_document().rowsBetween(Window.unboundedPreceding, 0))
    return materialize(pairs.withColumn("_lcp", F.coalesce(F.col("_lcp"), carried - F.col("_pos"))), "suffix-lcp")


def longest_repeats(order: DataFrame) -> DataFrame:
    """(_id, _th, _pos, longest): the most lines from a position on that occur at another position too."""
    after = order.select((F.col("_at") - 1).alias("_at"), F.col("_lcp").alias("_after"))
    return order.join(after, "_at", "left").select(*_KEY, "_pos", F.greatest("_lcp", F.coalesce("_after", F.lit(0))).alias("longest"))


def repeated_positions(order: DataFrame, min_lines: int) -> DataFrame:
    """(_id, _th, _pos, name) of the positions in an interval of the suffix order
    with common prefixes of ``min_lines`` or more; ``name`` is its first position."""
    rows = order.withColumns({"_block": F.expr(f"_at div {_BLOCK}"), "_new": F.when(F.col("_lcp") < min_lines, F.col("_at"))})
    # One row for each block: where the last interval begun in earlier blocks starts.
    blocks = rows.groupBy("_block").agg(F.max("_new").alias("_new"))
    blocks = blocks.select("_block", F.max("_new").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.max("_new").over(w)).join(blocks, "_block").withColumn("_interval", F.coalesce("_own", "_carry"))
    rows = rows.select(*_KEY, "_pos", "_interval")
    return _named(materialize(rows, "line-intervals"), ["_interval"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
                  long_words: int | None = None) -> DataFrame:
    """(_id, _th, runs) of the documents with a line run to delete: ``runs`` is
    their sorted array of struct<from, to> (line numbers from 0, ``to`` left out)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # What is said of a text is said before it is exploded: above the lines it would be worked out for each of them.
    cut = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.split(text, "\n").alias("_cut")).withColumn("_n", F.size("_cut"))
    lines = cut.select(*_KEY, "_n", F.posexplode("_cut").alias("_pos", "_text"))
    line = F.unhex(F.md5(F.col("_text").cast("binary"))).alias("_line")
    long = [] if long_words is None else [((F.regexp_count("_text", F.lit(WORD)) >= long_words) | (F.col("_n") == 1)).alias("_long")]
    lines = materialize(lines.select("_id", "_th", "_pos", "_n", line, *long), "lines")
    copies = lambda names, n: names.where(F.col("name") != _at()).select(*_KEY, "_pos", (F.col("_pos") + n).alias("_to"))
    shared = _shared(lines, ["_line"])
    later = copies(repeated_positions(suffix_order(lines, shared), min_lines), min_lines)
    if long:
        later = later.unionByName(copies(_named(lines.where("_long"), ["_line"], shared), 1))
    later = later.groupBy(*_KEY, "_pos").agg(F.max("_to").alias("_to"))
    w = Window.partitionBy(*_KEY).orderBy("_pos")
    starts = F.coalesce(F.col("_pos") > F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = later.withColumn("_new", starts.cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = runs.groupBy(*_KEY, "_run").agg(F.min("_pos").alias("from"), F.max("_to").alias("to"))
    return runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))  # at most a document's lines


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
                out: str = "kept", runs_col: str = "removed_runs", long_words: int | None = None) -> DataFrame:
    """``docs`` with ``out``, the text without the later copies of repeated runs
    of ``min_lines`` lines or more, and ``runs_col``, the runs removed.  With
    ``long_words``, later copies of single lines go too where a line has that
    many words or is all of its document.

    A run stays where it first occurs, by id (null ids first), then by line
    number; copies may overlap within a document.  What occurs is judged on the
    input, not on what is left.  A null text counts as empty, which is one empty
    line.  Rows equal in id and text count as one document.  Columns of these
    names are replaced.
    """
    src = docs.drop(out, runs_col)
    runs = repeated_runs(src.select(id_col, text_col), id_col, text_col, min_lines, long_words)
    none = F.array().cast("array<struct<from:int,to:int>>")
    runs = runs.select(F.col("_id").alias("_ld_rid"), F.col("_th").alias("_ld_rth"), F.col("runs").cast("array<struct<from:int,to:int>>").alias(runs_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = src.withColumns({"_ld_th": F.xxhash64(text), "_ld_lines": F.split(text, "\n")})
    found = found.join(runs, F.col("_ld_th").eqNullSafe(F.col("_ld_rth")) & F.col(id_col).eqNullSafe(F.col("_ld_rid")), "left")
    found = found.withColumn(runs_col, F.coalesce(runs_col, none))
    r, lines = F.col(runs_col), F.col("_ld_lines")
    starts = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["to"]))
    ends = F.concat(F.transform(r, lambda x: x["from"]), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))
    return found.withColumn(out, F.array_join(left, "\n")).drop("_ld_th", "_ld_lines", "_ld_rid", "_ld_rth")


MIN_LINES = 2

ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
runs AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lines),
named AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS d, first_value(pos) OVER w AS p FROM runs WHERE run IS NOT NULL
  WINDOW w AS (PARTITION BY run ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM named, range({MIN_LINES}) t(k) WHERE d <> doc_id OR p <> pos)
SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.pos IS NULL), '')) AS kept_md5
FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
"""

#: Words from which a line is a passage of its own.
LONG_WORDS = 30

ORACLE_LONG = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         len(string_split(coalesce(text, ''), chr(10))) AS n
  FROM documents),
pairs AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM lines),
named AS (
  SELECT doc_id, pos, {MIN_LINES} AS size, row_number() OVER (PARTITION BY pair ORDER BY doc_id, pos) AS nth FROM pairs WHERE pair IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, CASE WHEN n = 1 OR len(regexp_extract_all(line, '{WORD}')) >= {LONG_WORDS} THEN 1 ELSE 0 END,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) FROM lines),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM named, range({MIN_LINES}) t(k) WHERE nth > 1 AND k < size)
SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.pos IS NULL), '')) AS kept_md5
FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
"""
