"""Market snapshot assembly (A8): every per-date result folded into one row.

Each piece is first reduced to at most one row per key (a struct for 1-row
results, an ordered array of structs for top lists), then the pieces are
joined on the key.  With no key the pieces are attached as scalar subqueries.
A missing piece becomes an empty struct/array downstream (renderers are
null-safe), never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_struct(df: DataFrame, name: str, key: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in df.columns if c not in key]
    return df.select(*key, F.struct(*cols).alias(name))


def as_list(df: DataFrame, name: str, order: Sequence[str], key: Sequence[str] = (),
            desc: Sequence[bool] | None = None) -> DataFrame:
    """Rows -> one ordered array per key (lists come from top-n, so they are short)."""
    cols = [c for c in df.columns if c not in key]
    desc = list(desc) if desc is not None else [False] * len(order)
    sort_keys = []
    for o, d in zip(order, desc):
        # negate numeric keys for descending order inside sort_array
        sort_keys.append((-F.col(o)).alias(f"_k_{o}") if d else F.col(o).alias(f"_k_{o}"))
    packed = F.struct(*sort_keys, F.struct(*cols).alias("_row"))
    g = df.groupBy(*key).agg(F.sort_array(F.collect_list(packed)).alias("_s"))
    return g.select(*key, F.transform("_s", lambda s: s["_row"]).alias(name))


def snapshot(pieces: dict[str, DataFrame], key: Sequence[str] = ()) -> DataFrame:
    """Combine single-column pieces (output of as_struct / as_list) into one row per key."""
    names = list(pieces)
    if not key:
        first = pieces[names[0]]
        base = first.select(first[names[0]])
        out = base
        for n in names[1:]:
            out = out.withColumn(n, pieces[n].select(n).scalar())
        return out
    out = pieces[names[0]]
    for n in names[1:]:
        out = out.join(pieces[n], list(key), "left")
    return out
