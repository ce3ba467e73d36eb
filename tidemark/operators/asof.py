"""Operators over ordered data: as-of join (J1), as-of position (A6), trailing
windows (A3).  None of them puts a group whole into one task: groups are cut
into ranges of (key, time), and what a range needs from the others is carried
over in tables with a row for each range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..session import materialize
from .clean import with_bar_return
from .joins import normalise_code, null_safe_join


def _in_ranges(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` as a table dealt by ranges of ``order``, the range in ``_pid``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)


def asof_join(facts: DataFrame, dim: DataFrame, on: str | Sequence[str], fact_time: str, dim_time: str,
              values: Sequence[str]) -> DataFrame:
    """``facts`` with ``values`` of the latest row of ``dim`` at or before each
    row's time, per key (null where there is none).

    Facts and dimension rows are laid together in ranges of (key, time); inside
    a range the last dimension row goes down by a window, and the last row of
    each range goes to the later ranges of its key.  A hot key is as many ranges
    as it has rows for; facts equal in key and time are spread, too.  Of
    dimension rows with equal key and time the one with the greatest values
    counts.  Null keys and times meet nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    cols = facts.columns
    f = facts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"),
                     F.monotonically_increasing_id().alias("_spread"), F.struct(*cols).alias("_f"))
    ok = F.col(dim_time).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    d = dim.where(ok).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(dim_time).alias("_t"), F.lit(0).alias("_kind"),
                             F.lit(0).cast("long").alias("_spread"), F.struct(*values).alias("_d"))
    ks = [f"_k{i}" for i in range(len(keys))]
    # Null times sort first, so such facts stand before every dimension row of their key.
    laid = _in_ranges(f.unionByName(d, allowMissingColumns=True), [*map(F.col, ks), F.col("_t"), F.col("_kind"), F.col("_spread")], "asof")
    ends = laid.groupBy("_pid", *ks).agg(F.max(F.when(F.col("_kind") == 0, F.struct("_t", "_d")))["_d"].alias("_end"))
    before = Window.partitionBy(*ks).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # Only a key that a range boundary cuts has a row here: fewer rows than ranges.
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).where(F.col("_carry").isNotNull()).select("_pid", *ks, "_carry")
    inside = Window.partitionBy("_pid", *ks).orderBy("_t", "_kind", "_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = laid.withColumn("_here", F.last("_d", ignorenulls=True).over(inside)).where("_kind = 1")
    out = null_safe_join(filled, carried, ["_pid", *ks], "left")
    got = F.coalesce("_here", "_carry")
    return out.select("_f", got.alias("_got")).select(*[F.col(f"_f.{c}").alias(c) for c in cols], *[F.col(f"_got.{v}").alias(v) for v in values])


def with_sector_asof(quotes: DataFrame, sector_map: DataFrame, key: str = "code", dim: str = "industry", out: str = "industry_name",
                     date: str = "trade_date", map_date: str = "trade_date", vendor_codes: bool = False) -> DataFrame:
    """Quotes with the industry that the map in force on their trade date gives
    (J1): the latest map row at or before it."""
    m = sector_map.select(F.col(key).alias("_code"), F.col(map_date).alias("_since"), F.col(dim).alias(out))
    q = quotes.drop(out).withColumn("_code", F.col(key))
    if vendor_codes:
        q, m = q.withColumn("_code", normalise_code(key)), m.withColumn("_code", normalise_code("_code"))
    return asof_join(q, m, "_code", date, "_since", [out]).drop("_code")


# ---------------------------------------------------------------- position among earlier rows


def running_before(df: DataFrame, order: str, count: str, by: Sequence[str], out: str) -> DataFrame:
    """Sum of ``count`` over the rows before, in the order of distinct values
    ``order``, per ``by`` group: sums of ranges and a window inside each."""
    laid = _in_ranges(df, [*map(F.col, by), F.col(order)], "running")
    sums = laid.groupBy("_pid", *by).agg(F.sum(count).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_pid", *by, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = laid.withColumn("_here", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return null_safe_join(here, sums, ["_pid", *by]).withColumn(out, F.col("_off") + F.col("_here")).drop("_pid", "_off", "_here")


def dominated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row, the number of rows with a lesser x and a lesser y, by
    counting merges: runs of doubling length, sorted by y."""
    n = len(x)
    x, rank = (np.unique(a, return_inverse=True)[1].astype(np.int64) for a in (x, y))
    order = np.lexsort((-rank, x))  # rows of equal x: greater y first, so that none counts another
    rank = rank[order]
    out, span, width = np.zeros(n, np.int64), int(rank.max(initial=0)) + 1, 1
    place = np.arange(n)
    while width < n:
        run = place // width
        left = np.sort((run * span + rank)[run % 2 == 0])  # runs are apart by their number
        right = run % 2 == 1
        first = np.searchsorted(left, (run[right] - 1) * span)
        out[right] += np.searchsorted(left, (run[right] - 1) * span + rank[right]) - first
        width *= 2
    got = np.empty(n, np.int64)
    got[order] = out
    return got


def _counted(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """``df`` with the dominated rows of its group added to ``_below``."""
    def run(table: pa.Table) -> pa.Table:
        more = dominated(table[x].to_pandas().to_numpy(), table[y].to_pandas().to_numpy())
        return table.set_column(table.column_names.index("_below"), "_below", pa.array(table["_below"].to_numpy() + more, pa.int64()))

    return df.groupBy(*group).applyInArrow(run, df.schema)


def earlier_below(df: DataFrame, order: str, value: str, by: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """``df`` with ``n_earlier``, the rows of a lesser ``order``, and ``n_below``,
    those of them whose ``value`` is less, per ``by`` group.

    Rows are cut into blocks of about ``block_rows`` by order and into cells by
    value (20,000, or four roots of the largest group: the table of blocks and
    cells then has a row for 16 rows at most).  Rows of earlier blocks and lower cells are counted by a table of
    blocks and cells; those of the same block and a lower cell inside the block;
    those of the same cell inside the cell.  An order or a value that alone fills
    a block has one of its own, in which nothing is less, so it is not counted
    through and no group outgrows a task.  Rows with a null order or value are
    not counted and get nulls.
    """
    cols, by = df.columns, list(by)
    rows = df.select(F.struct(*cols).alias("_row"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(order).alias("_t"), F.col(value).alias("_v"))
    gs = [f"_b{i}" for i in range(len(by))]
    rows = materialize(rows.withColumn("_use", F.col("_t").isNotNull() & F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double"))), "position-rows")
    live = rows.where("_use")
    if block_rows is None:
        largest = live.groupBy(*gs).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        block_rows = max(20_000, 4 * math.isqrt(largest))

    def cut(axis: str, name: str) -> DataFrame:
        """Each value of the axis with the number of its block (odd: its own) and the rows before it."""
        per = live.groupBy(*gs, axis).agg(F.count(F.lit(1)).alias("_n"))
        per = running_before(per, axis, "_n", gs, "_before")
        hot = (F.col("_n") >= block_rows).cast("long")
        return per.select(*gs, axis, (F.floor(F.col("_before") / block_rows) * 2 + hot).alias(name), F.col("_before").alias(f"{name}_before"))

    placed = materialize(null_safe_join(null_safe_join(live, cut("_t", "_block"), [*gs, "_t"]), cut("_v", "_cell"), [*gs, "_v"]), "position-placed")
    # Rows of earlier blocks and lower cells: a table of blocks and cells, both few beside the rows.
    grid = placed.groupBy(*gs, "_block", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = grid.groupBy(*gs).agg(F.collect_set("_cell").alias("_cells"))
    full = null_safe_join(grid.select(*gs, "_block").distinct(), cells, gs) if gs else grid.select("_block").distinct().withColumn("_cells", cells.scalar())
    full = full.select(*gs, "_block", F.explode("_cells").alias("_cell"))
    full = null_safe_join(full, grid, [*gs, "_block", "_cell"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    earlier = Window.partitionBy(*gs, "_cell").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*gs, "_block").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("_up", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    full = full.select(*gs, "_block", "_cell", F.coalesce(F.sum("_up").over(lower), F.lit(0)).alias("_below"))
    placed = null_safe_join(placed, full, [*gs, "_block", "_cell"])
    alone = F.col("_block") % 2 == 1
    placed = _counted(placed.where(~alone), [*gs, "_block"], "_t", "_cell").unionByName(placed.where(alone))
    alone = F.col("_cell") % 2 == 1
    placed = _counted(placed.where(~alone), [*gs, "_cell"], "_t", "_v").unionByName(placed.where(alone))
    none = F.lit(None).cast("long")
    out = placed.select("_row", F.col("_block_before").alias("n_earlier"), F.col("_below").alias("n_below"))
    out = out.unionByName(rows.where("not _use").select("_row", none.alias("n_earlier"), none.alias("n_below")))
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in cols], "n_earlier", "n_below")


def position_asof(series: DataFrame, order: str, value: str, by: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """``series`` with ``percentile``: 100 times the share of earlier rows whose
    value is strictly below, 1dp (A6 for every date); null for the first."""
    got = earlier_below(series, order, value, by, block_rows)
    share = F.when(F.col("n_earlier") > 0, F.col("n_below").cast("double") / F.col("n_earlier") * 100)
    return got.select(*series.columns, "n_earlier", round_half_up(share, 1).alias("percentile"))


# ---------------------------------------------------------------- trailing windows


def trailing_stats(bars: DataFrame, date: str, days: int = 365, open_col: str = "open", close_col: str = "close",
                   by: Sequence[str] = (), span_days: int | None = None) -> DataFrame:
    """For each bar the statistics of A3 over the ``days`` days up to its date:
    n_bars, close_min, close_max, close_avg, volatility (sample stddev of the
    intraday return), 2dp, per ``by`` group.

    Time is cut into spans of ``span_days`` (four windows, unless given); a bar
    goes to its own span and, if a later day's window reaches it, to the next,
    so a span is one task's window whatever the length of the series.  Bars
    without a date are left out.
    """
    span = span_days or 4 * days
    if span < days:
        raise ValueError("a span holds at least one window")
    b = with_bar_return(bars.where(F.col(date).isNotNull()), open_col, close_col, "_ret").withColumn("_day", F.unix_date(F.col(date).cast("date")))
    own = F.floor(F.col("_day") / span)
    last = F.floor((F.col("_day") + (days - 1)) / span)
    b = b.withColumn("_own", own).withColumn("_span", F.explode(F.array_distinct(F.array(own, last))))
    w = Window.partitionBy(*by, "_span").orderBy("_day").rangeBetween(-(days - 1), 0)
    over = lambda c: c.over(w)
    mean = F.try_divide(over(F.sum(F.col(close_col).cast("decimal(30,8)"))).cast("double"), over(F.count(close_col)).cast("double"))
    out = b.select(*bars.columns, "_own", "_span", over(F.count(F.lit(1))).alias("n_bars"), round_half_up(over(F.min(close_col)), 2).alias("close_min"),
                   round_half_up(over(F.max(close_col)), 2).alias("close_max"), round_half_up(mean, 2).alias("close_avg"),
                   round_half_up(over(F.stddev_samp("_ret")), 2).alias("volatility"))
    return out.where("_own = _span").drop("_own", "_span")
