"""Batch embedding.

Two ways to turn text into vectors:

* ``hash_embed``: hashed n-gram features, unit-length ARRAY<FLOAT>.  Character
  n-grams (the default, which also fits text without spaces between words) are
  counted with NumPy over Arrow batches; word n-grams stay in the JVM
  (NGram -> HashingTF -> Normalizer).
* ``embed_with``: a user-supplied function (e.g. a remote model client) called
  on batches of ``batch`` texts in order, through Arrow (mapInPandas).  An
  empty input gives no calls.

``embed_changed`` puts a store of vectors, addressed by the texts' md5, before
either of them, so that a text is embedded once however often it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .upsert import read_if_there

GRAM_BASE = 65_599


def _char_grams(dims: int, n: int):
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            v = np.zeros(dims)
            if len(points) >= n:
                bucket = np.zeros(len(points) - n + 1, np.int64)
                for k in range(n):
                    bucket = (bucket * GRAM_BASE + points[k: k + len(bucket)]) % dims
                v = np.bincount(bucket, minlength=dims) / 1.0
                v /= np.sqrt((v * v).sum())
            out.append(v.astype(np.float32))
        return pd.Series(out)
    return embed


def hash_embed(df: DataFrame, text: str, out: str = "embedding", dims: int = 1536, n: int = 2,
               unit: str = "char") -> DataFrame:
    """Unit-normalised hashed n-gram features.

    ``unit="char"``: character n-grams of length ``n`` of the lower-cased text;
    an n-gram's bucket is the polynomial of its code points (base
    ``GRAM_BASE``) modulo ``dims``, which SQL can compute as well.
    ``unit="word"``: lower-cased word unigrams plus word bigrams.  A text with
    no n-gram (null, blank) gets an all-zero vector, which retrieval never
    returns.
    """
    if unit == "char":
        return df.withColumn(out, _char_grams(dims, n)(F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))))
    if unit != "word":
        raise ValueError(f"unknown unit {unit!r}")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    staged = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    stages = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[\p{L}\p{N}]+", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_w", outputCol="_b"),
    ]
    tokens = F.concat(F.col("_w"), F.col("_b"))
    grams = Pipeline(stages=stages).fit(staged.limit(0)).transform(staged)
    grams = grams.withColumn("_g", tokens)
    tail = Pipeline(stages=[
        HashingTF(numFeatures=dims, inputCol="_g", outputCol="_tf"),
        Normalizer(p=2.0, inputCol="_tf", outputCol="_unit"),
    ]).fit(grams.limit(0))
    res = tail.transform(grams)
    drop = [c for c in ["_t", "_w", "_b", "_g", "_tf", "_unit"] if c in res.columns]
    return res.withColumn(out, vector_to_array("_unit", "float32")).drop(*drop)


def embed_with(df: DataFrame, text: str, fn: Callable[[list[str]], Sequence[Sequence[float]]],
               out: str = "embedding", batch: int = 20) -> DataFrame:
    """Call ``fn`` on consecutive batches of ``batch`` texts per partition.

    ``fn`` returns one vector per input text, in order.  A failing batch fails
    its task, which Spark retries; the function should be idempotent.
    """
    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType(list(df.schema.fields)).add(out, ArrayType(FloatType()))
    cols = df.columns

    def run(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            texts = pdf[text].fillna("").astype(str).tolist()
            vecs: list = []
            for i in range(0, len(texts), batch):
                chunk = texts[i:i + batch]
                got = list(fn(chunk))
                if len(got) != len(chunk):
                    raise ValueError(f"embedding function returned {len(got)} vectors for {len(chunk)} texts")
                vecs.extend(got)
            res = pdf[cols].copy()
            res[out] = pd.Series([list(map(float, v)) for v in vecs], index=pdf.index)
            yield res

    return df.mapInPandas(run, schema)


def embed_changed(df: DataFrame, text: str, store_path: str, embed: Callable[[DataFrame, str], DataFrame], out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of its texts, embedding only texts that the store
    at ``store_path`` (a Parquet table: key, ``out``) doesn't hold.

    ``embed`` maps (frame, text column) to the frame with a column ``out``, e.g.
    ``lambda d, c: embed_with(d, c, client)``.  Each distinct new text is passed
    once; its vector is added to the store, which is never rewritten: another
    model takes another store.  A null text counts as empty.  One writer at a
    time.
    """
    spark = df.sparkSession
    keyed = df.drop(out).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    keyed = keyed.withColumn("_key", F.md5(F.col("_text").cast("binary")))
    asked = keyed.groupBy("_key").agg(F.min("_text").alias("_text"))
    stored = read_if_there(spark, store_path)
    if stored is not None:
        asked = asked.join(stored.select(F.col("key").alias("_key")), "_key", "left_anti")
    new = embed(materialize(asked, "texts-to-embed"), "_text").select(F.col("_key").alias("key"), out)
    materialize(new, "new-vectors").write.mode("append").parquet(store_path)
    vectors = spark.read.parquet(store_path).select(F.col("key").alias("_stored"), out)
    return keyed.join(vectors, F.col("_key") == F.col("_stored")).drop("_text", "_key", "_stored")
