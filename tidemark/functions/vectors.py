"""Vector column helpers built from higher-order functions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """dot/(|a||b|); null when either vector has zero length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def similarity_from_distance(d: ColumnOrName) -> Column:
    """max(0, 1 - d), the score shown next to a hit."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - col(d))


def l2_normalise(a: ColumnOrName) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))
