"""Top-N (T1-T3, W3, P10, T7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(value: str, desc: bool, tiebreak: Sequence[str]) -> list[Column]:
    first = F.col(value).desc() if desc else F.col(value).asc()
    return [first] + [F.col(t).asc() for t in tiebreak]


def top_n(df: DataFrame, value: str, n: int, *, desc: bool = True,
          tiebreak: Sequence[str] = ("code",), by: Sequence[str] = (),
          cols: Sequence[str] | None = None, rank_col: str | None = None) -> DataFrame:
    """The n rows with the largest (or smallest) ``value``; null values never appear.

    Without ``by`` this is ORDER BY ... LIMIT n, which Spark runs as a per-task
    top-n followed by one small merge (TakeOrderedAndProject): no full sort.
    With ``by`` it is ``row_number() <= n`` per group; Spark adds a partial
    WindowGroupLimit before the shuffle, so a hot group ships at most n rows per
    task.  Ties are broken by ``tiebreak`` ascending.
    """
    base = df.where(F.col(value).isNotNull())
    keep = list(cols) if cols is not None else df.columns
    if not by:
        out = base.orderBy(*_order(value, desc, tiebreak)).limit(n)
        if rank_col:
            # rank within n rows: a window over n rows only
            w = Window.orderBy(*_order(value, desc, tiebreak))
            out = out.withColumn(rank_col, F.row_number().over(w))
            keep = keep + [rank_col]
        return out.select(*keep)
    w = Window.partitionBy(*by).orderBy(*_order(value, desc, tiebreak))
    rn = rank_col or "_rn"
    out = base.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    sel = [c for c in keep if c not in by]
    return out.select(*by, *sel, *([rank_col] if rank_col else []))


def big_movers(top: DataFrame, value: str = "change_pct", threshold: float = 5.0) -> DataFrame:
    """Rows of an already-ranked top list whose |value| exceeds the threshold (P10)."""
    return top.where(F.abs(F.col(value)) > threshold)


def head_of(arr: str | Column, n: int) -> Column:
    """First n elements of an array column (display slices, T7)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(c, 1, n)
