"""Cleaning and per-row derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, to_double


def clean_quotes(
    df: DataFrame,
    code: str = "code",
    name: str = "name",
    price: str = "price",
    change: str = "change_pct",
    volume: str = "volume",
    amount: str = "amount",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Coerce numerics (bad text -> null), keep rows with a code and a positive price.

    Output: code, name, price, change_pct, volume_num, amount_num (+ ``keep``).
    Rows with a null change or amount are kept.  A numeric price is compared as
    it is, so on Parquet the test reaches the scan as a pushed filter; only a
    text price is parsed first.
    """
    price_d = to_double(price)
    if dict(df.dtypes)[price] in ("double", "float"):
        df = df.where(F.col(code).isNotNull() & (F.col(price) > 0) & ~F.isnan(price))  # NaN compares as greater
    out = df.select(
        *[F.col(k) for k in keep],
        F.col(code).alias("code"),
        F.col(name).alias("name"),
        price_d.alias("price"),
        to_double(change).alias("change_pct"),
        to_double(volume).alias("volume_num"),
        to_double(amount).alias("amount_num"),
    )
    return out.where(F.col("code").isNotNull() & F.col("price").isNotNull() & (F.col("price") > 0))


def with_bar_return(df: DataFrame, open_col: str = "open", close_col: str = "close",
                    out: str = "change_pct", digits: int | None = None) -> DataFrame:
    """Intraday return (close-open)/open*100; null when open is 0 or missing."""
    r = F.try_divide(F.col(close_col) - F.col(open_col), F.col(open_col)) * F.lit(100.0)
    r = F.when(F.col(open_col) != 0, r)
    if digits is not None:
        r = round_half_up(r, digits)
    return df.withColumn(out, r)


def with_year(df: DataFrame, date_col: str = "date", out: str = "year") -> DataFrame:
    """Calendar year; text dates use their first four characters."""
    dtype = dict(df.dtypes)[date_col]
    if dtype == "string":
        y = F.substring(F.col(date_col), 1, 4).try_cast("int")
    else:
        y = F.year(F.col(date_col)).cast("int")
    return df.withColumn(out, y)
