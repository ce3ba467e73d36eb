"""Joins (J1-J4, K3).  No hints: Spark picks broadcast or shuffle from sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet each other; the key columns are the left side's."""
    keys = [on] if isinstance(on, str) else list(on)
    side = right
    for k in keys:
        side = side.withColumnRenamed(k, f"_right_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(side[f"_right_{k}"])
    return left.join(side, cond, how).drop(*[f"_right_{k}" for k in keys])


def latest_per_key(df: DataFrame, key: Sequence[str] | str, version: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``version``, ties by the row's values.

    Runs as max(struct(version, values...)) per key: a partial aggregate, so a
    key repeated in a third of all rows is combined map-side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c != version]
    packed = ([F.col(version)] if version else []) + [F.col(c) for c in rest]
    if not packed:
        return df.select(*keys).distinct()
    pick = F.max(F.struct(*packed)).alias("_pick")
    out = df.groupBy(*keys).agg(pick)
    sel = [F.col(k) for k in keys] + [F.col(f"_pick.{c}").alias(c) for c in rest]
    if version:
        sel.append(F.col(f"_pick.{version}").alias(version))
    return out.select(*sel)


def with_dimension(facts: DataFrame, dim: DataFrame, key: str | Sequence[str], *, how: str = "left") -> DataFrame:
    """Attach a dimension table (J1), which the caller has deduplicated.  A plain
    join: Spark broadcasts the dimension by its bytes, known or measured."""
    return facts.join(dim, key, how)


_DIGITS = r"(\d{6})"


def normalise_code(code: str = "code") -> Column:
    """Vendor stock code -> six digits: exchange prefixes and suffixes
    (``sh600000``, ``600000.SH``) go, short numbers (``1``) get leading zeros;
    text without digits stays as it is, trimmed."""
    c = F.trim(F.col(code))
    six = F.regexp_extract(c, _DIGITS, 1)
    short = F.regexp_extract(c, r"^(\d{1,5})$", 1)
    return F.when(six != "", six).when(short != "", F.lpad(short, 6, "0")).otherwise(c)


def with_sector(quotes: DataFrame, sector_map: DataFrame, key: str = "code",
                dim: str = "industry", out: str = "industry_name",
                version: str | None = "trade_date", multi: bool = False, vendor_codes: bool = False) -> DataFrame:
    """quotes LEFT JOIN (deduplicated) map; rows without a sector keep a null.

    ``vendor_codes``: both sides come from different vendors, so their codes
    meet in the form of ``normalise_code`` (the quotes keep their own code).
    """
    m = sector_map
    if vendor_codes:
        m = m.withColumn(key, normalise_code(key))
    if version and version not in m.columns:
        version = None
    if not multi:
        m = latest_per_key(m.select(key, dim, *([version] if version else [])), key, version)
    else:
        m = m.select(key, dim).distinct()
    if vendor_codes:
        m = m.select(F.col(key).alias("_code"), F.col(dim).alias(out))
        return quotes.withColumn("_code", normalise_code(key)).join(m, "_code", "left").drop("_code")
    m = m.select(F.col(key), F.col(dim).alias(out))
    return with_dimension(quotes, m, key, how="left")


def unmatched_count(joined: DataFrame, dim_col: str) -> DataFrame:
    """How many fact rows found no dimension row (reported, never dropped silently)."""
    return joined.agg(F.count_if(F.col(dim_col).isNull()).cast("long").alias("unmatched"))


def semi_in(facts: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``facts`` whose key is in ``keys``."""
    return facts.join(keys, on, "left_semi")


def new_only(incoming: DataFrame, existing: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not already landed."""
    return incoming.join(existing.select(*([on] if isinstance(on, str) else on)), on, "left_anti")
