"""The corpus pipeline: five stages over ``documents``, each calling an operator
of ``tidemark.llm``, written as Parquet and read again before the next.

Every stage but the last returns the columns of its input; what it drops or
repeats is what the next one works on.  No stage can be put in SQL whole (the
first learns a model, the second follows links to their components), so
``ORACLE_SQL`` is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, mixing, records, simhash
from tidemark.llm._common import read_table
from tidemark.llm.queries import op4_may_learn, word_bpe_path
from tidemark.session import ensure_checkpoint_dir, materialize, scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects (no letter, null text, or a
    calibrated probability below its threshold) go."""
    return langid.keep_identified(docs, langid.train(docs, may_learn=op4_may_learn()))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of least id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark passage go."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it."""
    return mixing.mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as binary records; one row per record as read back."""
    manifest = records.write_records(docs, scratch_path(spark, "pipeline-records"), word_bpe_path())
    return records.read_records(manifest, digest=True)


STAGES = [("language ID", language_id), ("SimHash near-dedup", simhash_dedup), ("benchmark decontamination", decontamination),
          ("mixing sources", source_mix), ("token records", token_records)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
