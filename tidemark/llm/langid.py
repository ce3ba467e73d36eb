"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated
rejection.

A text is the bag of its hashed byte n-grams (of the lower-cased text); its
vector is the mean of their embeddings, and a softmax layer turns it into one
probability per language.  Embeddings and layer are learned together.  For
prediction the two linear maps are multiplied once into a (bucket x language)
table, so a text costs one histogram and one small product.

The fit runs on the driver over a bounded sample (``rows_per_label`` documents
of each label, those of least hash of the id); all that comes to the driver is
a bucket histogram for each.  Prediction is a map over the documents, without a
shuffle, of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize
from ._common import free_names, rows_in, utf8

UNKNOWN = "und"
NGRAMS = (2, 3, 4)
#: Texts are hashed in pieces of so many bytes, which bounds the memory of one very long text.
PIECE = 1 << 20
#: Word counts of the excerpts of each sampled text that the fit adds, so that short texts are calibrated too.
EXCERPTS = (2, 5, 12, 40)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray = field(repr=False)  # bucket x label
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    threshold: float = 0.0

    @property
    def buckets(self) -> int:
        return len(self.table)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, calibrated probability, rejected)."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, True
        bag = histogram(text, self.buckets)
        logits = (bag @ self.table) / max(bag.sum(), 1) + self.bias
        p = softmax(logits[None] / self.temperature)[0]
        best = int(p.argmax())
        score = min(1.0, float(p[best]))
        return self.labels[best], score, score < self.threshold


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def histogram(text: str, buckets: int) -> np.ndarray:
    """Counts of the hashed byte n-grams; a boundary space is added at both ends."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(buckets, np.int64)
    longest = max(NGRAMS)
    for at in range(0, len(raw), PIECE):
        part = raw[at: at + PIECE + longest - 1].astype(np.uint32)
        gram = part
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | part[n - 1:]  # byte k of n at its own place; 4 bytes fill 32 bits
            if n in NGRAMS:
                own = gram[: min(PIECE, len(raw) - n + 1 - at)]
                mixed = (own * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519)
                counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(buckets), minlength=buckets)
    return counts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def excerpts(text: str, seed: int) -> list[str]:
    words = text.split()
    rng = np.random.default_rng(seed)
    out = []
    for n in EXCERPTS:
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n + 1))
            out.append(" ".join(words[at: at + n]))
    return out


@dataclass
class Bags:
    """Sparse rows of n-gram shares: ``at``/``share`` from start[i] to start[i + 1]."""

    start: np.ndarray
    at: np.ndarray
    share: np.ndarray
    buckets: int

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.buckets), np.float32)
        for k, r in enumerate(rows):
            s = slice(self.start[r], self.start[r + 1])
            out[k, self.at[s]] = self.share[s]
        return out


def fit(bags: Bags, truth: np.ndarray, check: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 12,
        rate: float = 0.4, batch: int = 64, seed: int = 7, reject: float = 0.001, highest: float = 0.4) -> LanguageModel:
    """SGD on the rows where ``check`` is false; temperature and threshold from
    the others: the temperature of least log loss, and the greatest threshold,
    at most ``highest``, that rejects at most the share ``reject`` of them."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (bags.buckets, dim)).astype(np.float32)
    lin = rng.normal(0, 0.1, (dim, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    rows = np.flatnonzero(~check)
    if not len(rows):
        rows = np.arange(len(truth))
    scale = np.float32(30)  # shares sum to one: without it the gradients of the embeddings are tiny
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            pick = rows[at: at + batch]
            xb = bags.dense(pick) * scale
            z = xb @ emb
            err = softmax(z @ lin + bias)
            err[np.arange(len(pick)), truth[pick]] -= 1
            err /= len(pick)
            lin_step, emb_step = z.T @ err, xb.T @ (err @ lin.T)
            lin -= step * lin_step
            bias -= step * err.sum(axis=0)
            emb -= step * emb_step
    table = (emb @ lin) * scale
    held = np.flatnonzero(check)
    temperature, threshold = 1.0, 0.0
    if len(held):
        logits = np.concatenate([bags.dense(held[k: k + 512]) @ table for k in range(0, len(held), 512)]) + bias
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(held)), truth[held]] + 1e-12).mean()
                for t in np.geomspace(0.25, 8, 21)}
        temperature = float(min(loss, key=loss.get))
        top = np.sort(softmax(logits / temperature).max(axis=1))
        threshold = float(min(highest, top[int(reject * len(top))]))
    return LanguageModel(labels, table.astype(np.float32), bias, temperature, threshold)


#: Of more labels than this the largest classes are learned.
MAX_LABELS = 1000
#: Rows of a sample altogether; many labels share it.
MAX_SAMPLE = 100_000


def sample_per_label(rows: DataFrame, id_col: str, label: str, n: int) -> DataFrame:
    """At most ``n`` rows of each label, those of the least hash of the id (the
    same on each run), and of at most ``MAX_LABELS`` labels, the largest.

    Labels are counted first, and only rows below the hash that lets some 1.5 n
    of a label through are shuffled and ranked; where ids repeat so that none is
    below it, the rows of the least hash are.  However ids repeat, no more than
    n rows of a label leave a task."""
    spark, others = rows.sparkSession, [c for c in rows.columns if c not in (id_col, label)]
    hashed = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 11) / F.lit(2.0**53))
    counts = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("_u").alias("least")).orderBy(F.col("n").desc(), label).limit(MAX_LABELS).collect()
    n = max(1, min(n, MAX_SAMPLE // max(1, len(counts))))
    limits = spark.createDataFrame([(r[0], max((1.5 * n + 50) / r.n, r.least)) for r in counts], f"_of {rows.schema[label].dataType.simpleString()}, _most double")
    # The limits have MAX_LABELS rows at most.
    near = hashed.join(F.broadcast(limits), F.col(label) == F.col("_of")).where(F.col("_u") <= F.col("_most"))
    w = Window.partitionBy(label).orderBy("_u", id_col, *[F.xxhash64(F.col(c)) for c in others])
    return materialize(near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).select(*rows.columns), "sampled-rows")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          may_learn: Column | None = None, rows_per_label: int = 500, buckets: int = 1 << 12) -> LanguageModel:
    """Fit on at most ``rows_per_label`` labelled documents of each label (and
    excerpts of them), of at most ``MAX_LABELS`` labels, the largest, and
    ``MAX_SAMPLE`` documents altogether.  Rows with a null id, label or text, and
    those for which ``may_learn`` isn't true, are never read.  No usable row
    gives a model without labels, which answers ``und``."""
    usable = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if may_learn is not None:
        usable = usable.where(may_learn)
    usable = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(text_col).alias("_text"))
    chosen = sample_per_label(usable, "_id", "_label", rows_per_label).where("_text is not null")

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches, 16):
            cols: list[list] = [[], [], [], [], []]
            for key, label, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not has_letter(text):
                    continue
                seed = int(np.frombuffer(str(key).encode().ljust(8, b"0")[-8:], "<u8")[0])
                for piece in [text, *excerpts(text, seed)]:
                    h = histogram(piece, buckets)
                    at = np.flatnonzero(h)
                    for col, v in zip(cols, (str(key), label, seed % 5 == 0, at.astype(np.int32), (h[at] / h.sum()).astype(np.float32))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float32())))],
                names=["id", "label", "held", "at", "share"])

    got = chosen.mapInArrow(bags, "id string, label string, held boolean, at array<int>, share array<float>")
    got = materialize(got, "langid-sample").orderBy("id", F.size("at").desc(), "at").toArrow().combine_chunks()
    labels = sorted(set(got["label"].to_pylist()))
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32))
    at, share = got["at"].combine_chunks(), got["share"].combine_chunks()
    bag = Bags(at.offsets.to_numpy(), at.values.to_numpy(), share.values.to_numpy(), buckets)
    place = {v: k for k, v in enumerate(labels)}
    return fit(bag, np.array([place[v] for v in got["label"].to_pylist()]), np.array(got["held"].to_pylist()), labels)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang: str = "lang_pred",
             score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` with the predicted label, its calibrated probability and whether
    the model rejects it.  A null text or one without a letter gives ``und``,
    score 0, rejected.  Columns of these names are replaced; rows stay where
    they are."""
    src = docs.drop(lang, score, rejected)
    schema = src.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score), F.lit(True).alias(rejected)).schema
    at = src.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches):
            got = [model.predict(t) for t in b.column(at).to_pylist()]
            a, p, r = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a, pa.string()), pa.array(p, pa.float64()), pa.array(r, pa.bool_())],
                                             names=[*b.schema.names, lang, score, rejected])

    return src.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, with the columns of ``docs``."""
    lang, score, rejected = free_names(docs, "_lang", "_score", "_rejected")
    return identify(docs, model, text_col, lang, score, rejected).where(~F.col(rejected)).select(*docs.columns)
