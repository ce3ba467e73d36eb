"""The registered queries of this subpackage: thin bindings of the operators to
the test tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc32_of_id, read_table
from ..session import scratch_path
from . import decontam, langid, lexical, linededup, manifest, merkle, mixing, quality, records, suffixes, threshold, tokencount
from .simhash import simhash_groups

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@register
def op1_simhash_dedup(spark, sf):
    return simhash_groups(read_table(spark, sf, "documents"))


def op4_may_learn():
    """False for the held-out documents, and for null ids."""
    return F.coalesce(crc32_of_id() % 4 != 2, F.lit(False))


@register
def op4_language_id(spark, sf):
    docs = read_table(spark, sf, "documents")
    model = langid.train(docs, may_learn=op4_may_learn())
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~op4_may_learn()).alias("held_out"), "lang_pred", "score", "rejected")


@register
def op9_decontamination(spark, sf):
    return decontam.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@register
def op6_source_mix(spark, sf):
    # Targets are cut to a thousandth of a word, which Spark and DuckDB round alike.
    return mixing.mix_plan(read_table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


ORACLE["op6_source_mix"] = mixing.ORACLE


def word_bpe_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@register
def op5_token_records(spark, sf):
    docs = read_table(spark, sf, "documents")
    manifest = records.write_records(docs, scratch_path(spark, "op5-records"), word_bpe_path())
    return records.read_records(manifest, digest=True)


@register
def op8_merkle_fingerprint(spark, sf):
    return merkle.edit_digest(read_table(spark, sf, "documents"))


ORACLE["op8_merkle_fingerprint"] = merkle.ORACLE


def op7_may_learn():
    """False for the held-out documents, and for null ids."""
    return F.coalesce(crc32_of_id() % 5 != 0, F.lit(False))


@register
def op7_quality_ranking(spark, sf):
    docs = read_table(spark, sf, "documents")
    out, model = quality.rank_quality(docs, read_table(spark, sf, "labels"), may_learn=op7_may_learn())
    return out.select("doc_id", (~op7_may_learn()).alias("held_out"), "score",
                      (F.col("score") >= model.cut).cast("int").alias("predicted"))


def _line_digest(out: DataFrame) -> DataFrame:
    removed = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return out.select("doc_id", lines.alias("n_lines"), removed.alias("n_removed"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


@register
def op2_line_dedup(spark, sf):
    return _line_digest(linededup.dedup_lines(read_table(spark, sf, "documents").select("doc_id", "text")))


ORACLE["op2_line_dedup"] = linededup.ORACLE


@register
def op2_line_dedup_long(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return _line_digest(linededup.dedup_lines(docs, long_words=linededup.LONG_WORDS))


ORACLE["op2_line_dedup_long"] = linededup.ORACLE_LONG


def op10_edits():
    """Three edits of each document, from its own length and words: an
    insertion in its first third, a replacement around its middle, and a cut
    before its end."""
    n, text = F.length(F.coalesce("text", F.lit(""))).cast("long"), F.coalesce("text", F.lit(""))
    part = lambda k, size: F.substring(text, F.lit(k), F.lit(size))
    return F.array(
        F.struct(F.floor(n / 4).alias("at"), F.lit(0).cast("long").alias("del"), F.concat(F.lit(" "), part(1, 60)).alias("ins")),
        F.struct(F.floor(n / 2).alias("at"), F.lit(25).cast("long").alias("del"), F.concat(F.col("source"), F.lit("\n"), F.col("lang")).alias("ins")),
        F.struct(F.floor(3 * n / 4).alias("at"), F.lit(200).cast("long").alias("del"), F.lit("").alias("ins"))).cast(f"array<{tokencount.EDIT}>")


@register
def op10_token_counts(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("edits", op10_edits()).select("doc_id", "text", "edits")
    out = tokencount.count_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "counts.n_tokens", "counts.n_edited", "counts.pieces", "counts.reencoded",
                      F.sha2(F.col("counts.edited").cast("binary"), 256).alias("edited_sha256"))


#: Passages of over 50 words.
OP3_PASSAGE = 51


@register
def op3_substring_dedup(spark, sf):
    out = suffixes.repeated_bytes(read_table(spark, sf, "documents"), passage_words=OP3_PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    # What follows the contract's columns tells the outcome: what is left, in bytes and in characters, and whether anything went;
    # and the words in passages that another document holds too, removed or (under 400 bytes) not.
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
                      F.char_length(F.col("kept").cast("string")).cast("long").alias("n_kept_chars"), (removed > 0).alias("touched"), "n_passage_words")


@register
def op11_ranked_search(spark, sf):
    return lexical.rank_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


ORACLE["op11_ranked_search"] = lexical.ORACLE


@register
def op12_vector_topk(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    return threshold.topk_inner(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE["op12_vector_topk"] = threshold.ORACLE


@register
def op13_dataset_manifest(spark, sf):
    """Where 2 divides the crc32 of the id, the text that is verified has lost its line breaks."""
    changed = [F.translate("text", "\n", "") if c == "text" else c for c in manifest.COLUMNS]
    claim = F.when(crc32_of_id() % 2 == 0, manifest.digest_of(changed))
    rows = manifest.manifest(read_table(spark, sf, "documents"), extra={"_tampered": claim})
    out = manifest.verify(rows.withColumn("_claimed", F.coalesce("_tampered", "_leaf")), "_claimed")
    return out.withColumnRenamed("_id", "doc_id")


ORACLE["op13_dataset_manifest"] = manifest.ORACLE
