"""Board -> constituent flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_boards(boards: DataFrame, board: str = "industry", members: str = "constituents",
                   max_boards: int | None = None, order: str | None = None) -> DataFrame:
    """(board, [ {code, name} ]) -> (code, name, industry) rows.

    A board whose member list is null (its fetch failed) contributes nothing.
    ``max_boards`` keeps the first boards in ``order`` (the reference fetched
    the first 90).
    """
    b = boards
    if max_boards is not None:
        if order is None:
            raise ValueError("max_boards needs an explicit board order")
        b = b.orderBy(F.col(order).asc(), F.col(board).asc()).limit(max_boards)
    ex = b.select(F.col(board).alias("industry"), F.explode(members).alias("m"))
    return ex.select(F.col("m.code").cast("string").alias("code"), F.col("m.name").alias("name"), "industry")
