"""Quality classifier by Bradley-Terry pairwise ranking.

A document has a strength, linear in its features, and is preferred to another
with probability sigmoid(strength - strength).  The fit runs over preference
pairs (a document labelled 1 against one labelled 0): logistic loss on feature
differences, by stochastic gradient descent.  A strength becomes a score in
[0, 1] by a logistic curve that is anchored at a quantile of the strengths of all
rows that may be learned from: the one that cuts off their share of label 0
scores ``cut``.

Features are counts over the whole text: shares of character classes and of
their neighbourships, lengths, and how often words and lines repeat.  The fit is
on the driver over a bounded sample (``rows_per_label`` documents of each label,
those of least hash of the id), of which only features arrive; the anchor is taken over
all labelled documents, of which only strengths are shuffled; scoring is a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._common import rows_in, utf8
from .langid import sample_per_label

CUT = 0.3
PIECE = 1 << 20
_CLASSES = ["other", "lower", "upper", "digit", "space", "newline", "stop", "comma", "quote", "bracket", "bar", "bang", "hash", "high"]


def _class_table() -> np.ndarray:
    """Byte -> number of its class."""
    t = np.zeros(256, np.uint8)
    for name, members in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
                          "space": b" \t", "newline": b"\n\r\x0b\x0c", "stop": b".", "comma": b",;:", "quote": b"'\"`-", "bracket": b"()[]{}<>/",
                          "bar": b"|_=+~^", "bang": b"!?", "hash": b"#$%&*@\\", "high": bytes(range(128, 256))}.items():
        t[list(members)] = _CLASSES.index(name)
    return t


_TABLE = _class_table()
N_CLASSES = len(_CLASSES)


def features(text: str | None) -> np.ndarray:
    """A fixed number of finite features; the empty text has its own well-defined ones."""
    text = text or ""
    data = utf8(text)
    raw = np.frombuffer(data, np.uint8)
    pairs = np.zeros(N_CLASSES * N_CLASSES, np.int64)
    for at in range(0, len(raw), PIECE):  # the memory of a very long text stays bounded
        k = _TABLE[raw[at: at + PIECE + 1]].astype(np.int64)
        if len(k) > 1:
            pairs += np.bincount(k[:-1] * N_CLASSES + k[1:], minlength=len(pairs))
    n = max(len(raw), 1)
    single = pairs.reshape(N_CLASSES, N_CLASSES).sum(axis=1)
    words = data.split()
    n_words = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    top = sorted(distinct.values(), reverse=True)[:5] or [0]
    same = sum(a == b for a, b in zip(words, words[1:]))
    titled = sum(w[:1].isupper() for w in words)
    caps = sum(w.isupper() for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    upper_all = sum(map(str.isupper, text)) if text and not text.isascii() else int(single[_CLASSES.index("upper")])
    letters = sum(map(str.isalpha, text)) if text and not text.isascii() else int(single[1] + single[2])
    rest = [np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), size.mean() if len(size) else 0, size.std() if len(size) else 0,
            np.log1p(n_words / max(len(lines), 1)), len(distinct) / n_words, np.log1p(len(distinct)) / np.log1p(n_words),
            top[0] / n_words, sum(top) / n_words, same / n_words, titled / n_words, caps / n_words, upper_all / max(letters, 1),
            letters / max(len(text), 1), len(set(lines)) / max(len(lines), 1), float(not words)]
    return np.concatenate([np.sqrt(pairs / n), np.sqrt(single / n), np.array(rest, np.float64)])


@dataclass
class RankModel:
    weights: np.ndarray = field(repr=False)
    mean: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    anchor: float = 0.0
    slope: float = 1.0
    cut: float = CUT

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Strictly rising in the strength; ``cut`` at the anchor."""
        z = self.slope * (self.strength(x) - self.anchor) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, better: np.ndarray, pairs: int = 400_000, batch: int = 128, rate: float = 0.2, l2: float = 1e-4,
              seed: int = 11, cut: float = CUT) -> RankModel:
    """Bradley-Terry weights from random pairs (better row, worse row)."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    w = np.zeros(x.shape[1])
    total = np.zeros_like(w)
    steps = pairs // batch
    for step in range(steps):
        d = z[rng.choice(good, batch)] - z[rng.choice(bad, batch)]
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        w += rate / (1 + 4 * step / steps) * ((p[:, None] * d).mean(axis=0) - l2 * w)
        if step >= steps // 2:
            total += w
    model = RankModel(total / max(1, steps - steps // 2), mean, scale, cut=cut)
    s = model.strength(x)
    model.anchor = float(np.quantile(s, (~better).mean()))
    spread = np.median(s[good]) - np.median(s[bad])
    model.slope = float(6 / max(spread, 1e-6))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        may_learn: Column | None = None, rows_per_label: int = 2500) -> tuple[RankModel, DataFrame]:
    """The model, anchored by its sample alone, and one label for each id (_id,
    _label) that may be learned from; see ``train``."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if may_learn is not None:
        usable = usable.where(may_learn)
    one = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    ids = sample_per_label(one, "_id", "_label", rows_per_label)  # at most two times that many rows
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id").select("_id", "_label", "_text")
    chosen = sample_per_label(chosen, "_id", "_label", rows_per_label)  # once more: an id may have any number of rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([features(t).tolist() for t in b.column(2).to_pylist()], pa.list_(pa.float64()))],
                names=["id", "label", "x"])

    got = chosen.mapInArrow(run, f"id {ids.schema['_id'].dataType.simpleString()}, label int, x array<double>")
    got = materialize(got, "quality-sample").toPandas()
    n = len(features(""))
    if got["label"].nunique() < 2:
        return RankModel(np.zeros(n), np.zeros(n), np.ones(n)), one
    got = got.sort_values("id", kind="stable")
    return fit_pairs(np.stack(got["x"].to_numpy()), got["label"].to_numpy() == 1), one


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          may_learn: Column | None = None, rows_per_label: int = 2500) -> RankModel:
    """Fit on at most ``rows_per_label`` documents of either label.  Rows with a
    null id or label and those for which ``may_learn`` isn't true are left out;
    an id labelled both ways counts as 0.  With a label missing altogether all
    strengths are 0, so every score is ``cut``."""
    model, one = fit(docs, labels, id_col, text_col, label_col, may_learn, rows_per_label)
    if model.weights.any():
        src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null").join(one.select("_id"), "_id", "left_semi")
        model.anchor = anchor_of_all(_strengths(src, model), one, model)
    return model


def _strengths(src: DataFrame, model: RankModel) -> DataFrame:
    """(_id, _text) -> (_id, _strength), a map."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches):
            x = np.stack([features(t) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, len(model.weights)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.strength(x))], names=["_id", "_strength"])

    return src.select("_id", "_text").mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, _strength double")


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                 may_learn: Column | None = None, rows_per_label: int = 2500, score: str = "score") -> tuple[DataFrame, RankModel]:
    """(id_col, ``score``) of every row, and the model: what ``train`` and
    ``score_quality`` give for the same table, with one pass of features over its
    texts.  The strengths are a table; the anchor and the scores both follow
    from it."""
    model, one = fit(docs, labels, id_col, text_col, label_col, may_learn, rows_per_label)
    rows = materialize(_strengths(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model), "quality-strengths")
    if model.weights.any():
        model.anchor = anchor_of_all(rows, one, model)
    z = F.lit(model.slope) * (F.col("_strength") - F.lit(model.anchor)) + F.lit(float(np.log(model.cut / (1 - model.cut))))
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    return rows.select(F.col("_id").alias(id_col), value.alias(score)), model


def anchor_of_all(strengths: DataFrame, one: DataFrame, model: RankModel) -> float:
    """The strength that cuts off the share of label 0 of all rows (_id,
    _strength) with a label (_id, _label): between two strengths where that
    share ends between them, or the strength that many rows there share.  The
    rank is off by at most a hundred thousandth of the rows."""
    all_rows = materialize(strengths.where("_id is not null").join(one, "_id").select("_label", "_strength"), "quality-labelled")
    n, worse = all_rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("_label") == 0, 1))).first()
    s = F.col("_strength")
    at = all_rows.agg(F.percentile_approx(s, worse / n, 100_000)).first()[0]
    below, above = all_rows.agg(F.count(F.when(s <= at, 1)), F.min(F.when(s > at, s))).first()
    return at if above is None or below > worse else (at + above) / 2


def score_quality(docs: DataFrame, model: RankModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with its score, higher where label 1 is likelier.  Null texts
    count as empty, and empty texts have a score.  A column of that name is
    replaced; rows stay where they are."""
    src = docs.drop(score)
    at = src.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_in(batches):
            x = np.stack([features(t) for t in b.column(at).to_pylist()]) if b.num_rows else np.zeros((0, len(model.weights)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, score])

    return src.mapInArrow(run, src.select("*", F.lit(0.0).alias(score)).schema)
