"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are summed (a partial aggregate, so a source with a
third of all rows ships one row per task).  Targets share the words of all
sources by weight, none above ``cap`` times its source: with level L,
target = least(cap * size, weight * L), and L follows from a few one-row
aggregates over the table of sources.  A document of a source with
rate = target / size is emitted floor(rate) times plus one hash-seeded
Bernoulli copy with the fraction as probability.  A source has ``TURNS`` seeds
to draw by (its documents' hashes, each turned by the same share of the circle);
their totals come from one more aggregate, and the seed whose total is nearest
to the target draws, which matters where a few long documents hold a source's
words.  The table of sources is joined plainly: Spark broadcasts it by its size
or splits the hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import row_number_by
from ..session import materialize
from ._common import WORD, free_names

SEED = "mix"
_DRAWS = 2.0**52
TURNS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed, id and whole text; 52 bits, so exact as a double."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_DRAWS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """(source, source_size) -> with weight, target, rate.

    Sources are weighted in code point order, null last, by ``weights`` in
    turn; together they get ``share`` of all words.  A source without words has
    target and rate 0.
    """
    ranked = row_number_by(sizes, [F.col("source").asc_nulls_last()], out="_rn")
    turn = F.array(*[F.lit(w) for w in weights])
    per = materialize(ranked.select("source", "source_size", F.element_at(turn, (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("weight")), "mix-sources")
    words, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    words, capped, level = words * share, -1, 0.0
    while weight:
        # The level only rises, so sources only join the capped ones.
        full = per.where(F.lit(float(cap)) * F.col("source_size") < F.col("weight") * F.lit(level))
        n, most, w = full.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("source_size") * cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped or w == weight:
            break
        capped, level = n, (words - most) / (weight - w)
    target = F.least(F.col("source_size") * float(cap), F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "weight", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def _copies(rate: Column, u: Column, turn: Column) -> Column:
    turned = F.pmod(u + turn / F.lit(float(TURNS)), F.lit(1.0))  # exact: 52 bits and 16ths
    return (F.floor(rate) + (turned < rate - F.floor(rate)).cast("long")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """A few bytes for each document, written once: id, source, size and draw."""
    return materialize(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        draw(F.col(id_col), F.col(text_col), seed).alias("_u")), "mix-sized")


def _with_turns(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """The table of sources (_source, source_size, target, rate) with the turn to draw by."""
    per = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    per = per.withColumnRenamed("source", "_source")
    drawn = sized.join(per, F.col("source").eqNullSafe(F.col("_source")))
    totals = drawn.groupBy("_source", "source_size", "target", "rate").agg(*[
        F.sum(_copies(F.col("rate"), F.col("_u"), F.lit(k)) * F.col("size")).alias(f"_t{k}") for k in range(TURNS)])
    off = F.array(*[F.abs(F.col(f"_t{k}") - F.col("target")) for k in range(TURNS)])
    turn = (F.array_position(off, F.array_min(off)) - 1).cast("int")
    return materialize(totals.select("_source", "source_size", "target", "rate", turn.alias("turn")), "mix-turns", 1)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, seed: str = SEED) -> DataFrame:
    """One row per input row: id_col, size (words), source, source_size, target,
    copies, taken (copies times size).

    A null text has size 0; a null source is a source of its own, the last.
    The draw depends on id and text alone, so reruns agree, and rows equal in
    both share one fate.  An empty table gives no rows.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    out = sized.join(_with_turns(sized, weights, share, cap), F.col("source").eqNullSafe(F.col("_source")))
    copies = _copies(F.col("rate"), F.col("_u"), F.col("turn"))
    return out.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    cols, (by, rate, turn, copy) = docs.columns, free_names(docs, "_mix_source", "_mix_rate", "_mix_turn", "_mix_copy")
    per = _with_turns(_sized(docs, id_col, text_col, source_col, seed), weights, share, cap).select(
        F.col("_source").alias(by), F.col("rate").alias(rate), F.col("turn").alias(turn))
    out = docs.join(per, F.col(source_col).eqNullSafe(F.col(by)))
    times = _copies(F.col(rate), draw(F.col(id_col), F.col(text_col), seed), F.col(turn)).cast("int")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*cols)


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) / {_DRAWS} AS u
  FROM documents),
per AS (
  SELECT source, source_size, (rn - 1) % 3 + 1 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn
        FROM sized GROUP BY source)),
steps AS (
  SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER w, 0) AS full_words, coalesce(sum(weight) OVER w, 0) AS full_weight
  FROM per WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (words - full_words) / CAST(weights - full_weight AS DOUBLE) AS l
  FROM steps WHERE 3 * source_size >= weight * ((words - full_words) / CAST(weights - full_weight AS DOUBLE))
  ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST LIMIT 1),
rates AS (
  SELECT source, source_size, least(3.0 * source_size, weight * l) AS target,
         CASE WHEN source_size > 0 THEN CAST(least(3.0 * source_size, weight * l) AS DOUBLE) / source_size ELSE 0 END AS rate
  FROM per, level),
copies AS (
  SELECT doc_id, rates.source, size, source_size, target, t,
         floor(rate) + CASE WHEN (u + t / {TURNS}.0::DOUBLE) % 1.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS n
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source, range({TURNS}) r(t)),
turns AS (
  SELECT source, arg_min(t, (off, t)) AS t FROM (
    SELECT source, t, abs(CAST(sum(CAST(n * size AS BIGINT)) AS BIGINT) - any_value(target)) AS off FROM copies GROUP BY source, t)
  GROUP BY source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(round(target, 3) AS DOUBLE) AS target, CAST(n * size AS BIGINT) AS taken
FROM copies JOIN turns ON copies.source IS NOT DISTINCT FROM turns.source AND copies.t = turns.t
"""
