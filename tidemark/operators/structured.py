"""Structured-output parsing and validation.

A model answer is accepted when it is a JSON object (directly, or inside the
first fenced code block), every required field is present and of a usable
type, and every bounded number is inside its range.  Numbers given as text
("0.5") are accepted where ``from_json`` would turn them into null; numbers
where text is asked for, nulls in lists and fractions in counts are not.  Each leaf is read from a VARIANT with
``try_variant_get``, all JVM-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import REJECT_HEAD_CHARS, fence_body, head

# Numeric bounds and optional fields of the analyst outputs.
BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "macro": {"pe_valuation.percentile": (0.0, 100.0), "confidence": (0.0, 1.0)},
    "technical": {"confidence": (0.0, 1.0)},
    "fund_flow": {"confidence": (0.0, 1.0)},
    "risk": {"fragility_score": (0.0, 1.0), "confidence": (0.0, 1.0)},
    "editor": {},
}
OPTIONAL: dict[str, set[str]] = {
    "technical": {"support_level", "resistance_level"},
}


def schema_of(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def _typed(v: Column, path: str, dtype: T.DataType) -> Column:
    return F.try_variant_get(v, path, dtype.simpleString())


def _present(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return got.isNotNull() & ~F.is_variant_null(got)


def _kind(x: Column) -> Column:
    """The JSON type of a variant: STRING, BIGINT, OBJECT<...>, ...; VOID for null."""
    return F.coalesce(F.schema_of_variant(x), F.lit("VOID"))


def _fits(x: Column, dtype: T.DataType) -> Column:
    """Is the variant a value of the type?  Text must be text; a number may be
    given as text; a count must be whole; lists and objects are checked through."""
    kind = _kind(x)
    if isinstance(dtype, T.StringType):
        return kind == "STRING"
    if isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(x, "$", "array<variant>")
        return kind.startswith("ARRAY") & F.coalesce(F.forall(items, lambda i: _fits(i, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.StructType):
        return kind.startswith("OBJECT") & _all([_fits(F.try_variant_get(x, f"$.{f.name}", "variant"), f.dataType) for f in dtype.fields])
    number = F.try_variant_get(x, "$", "double")
    plain = kind.rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)") & number.isNotNull() & ~F.isnan(number)
    whole = plain & (number == F.floor(number))
    return F.coalesce(whole if isinstance(dtype, T.LongType) else plain, F.lit(False))


def _checks(v: Column, st: T.StructType, prefix: str, optional: set[str],
            missing: list[Column], wrong: list[Column]) -> None:
    for f in st.fields:
        name = f"{prefix}{f.name}"
        path = "$." + name
        present = _present(v, path)
        if name not in optional:
            missing.append(~present)
        wrong.append(present & ~_fits(F.try_variant_get(v, path, "variant"), f.dataType))
        if isinstance(f.dataType, T.StructType):
            _checks(v, f.dataType, name + ".", optional, missing, wrong)


def _all(cs: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def _any(cs: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | F.coalesce(c, F.lit(False))
    return out


def parse_structured(df: DataFrame, raw: str, kind: str, *, ddl: str | None = None,
                     bounds: dict[str, tuple[float, float]] | None = None,
                     optional: set[str] | None = None, fence_first: bool = False,
                     out: str = "parsed") -> DataFrame:
    """Add ``status`` ('ok' | 'not_json' | 'missing' | 'type' | 'range'),
    ``out`` (the typed struct, null unless ok) and ``error_head`` (first 500
    characters of the raw answer, null when ok).

    ``fence_first`` is the editor's variant: a fenced block, when present, is
    parsed instead of the whole answer.
    """
    spark = df.sparkSession
    st = schema_of(spark, ddl or (schemas.REPORT if kind == "editor" else schemas.ANALYST_SCHEMAS[kind]))
    bnds = BOUNDS.get(kind, {}) if bounds is None else bounds
    opt = OPTIONAL.get(kind, set()) if optional is None else optional
    r = F.col(raw)
    fenced = F.try_parse_json(fence_body(r))
    direct = F.try_parse_json(F.trim(r))
    is_obj = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    if fence_first:
        v = F.when(fence_body(r).isNotNull(), fenced).otherwise(direct)
    else:
        v = F.when(is_obj(direct), direct).otherwise(fenced)
    staged = df.withColumn("_v", v)
    vv = F.col("_v")
    missing: list[Column] = []
    wrong: list[Column] = []
    _checks(vv, st, "", opt, missing, wrong)
    out_of_range = [
        (~F.coalesce(_typed(vv, "$." + p, T.DoubleType()).between(lo, hi), F.lit(True)))
        for p, (lo, hi) in bnds.items()
    ]
    status = (
        F.when(~is_obj(vv), F.lit("not_json"))
        .when(_any(missing), F.lit("missing"))
        .when(_any(wrong), F.lit("type"))
        .when(_any(out_of_range), F.lit("range"))
        .otherwise(F.lit("ok"))
    )
    typed = F.struct(*[_typed(vv, "$." + f.name, f.dataType).alias(f.name) for f in st.fields])
    res = staged.withColumn("status", status)
    res = res.withColumn(out, F.when(F.col("status") == "ok", typed))
    res = res.withColumn("error_head", F.when(F.col("status") != "ok", head(r, REJECT_HEAD_CHARS)))
    return res.drop("_v")


def split_parsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) views of a parse_structured result."""
    return df.where(F.col("status") == "ok"), df.where(F.col("status") != "ok")
