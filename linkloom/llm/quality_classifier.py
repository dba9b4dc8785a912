"""Co-training of two document classifiers on separate views.

The content view sees the hashed words of a text, the metadata view language,
source, sizes and layout. Each view is a naive Bayes model, so training is
counting: every round both models label the unlabelled documents, each hands
the ones it is sure of to the other, and counts are summed before the shuffle.
Views are calibrated on held-out labelled documents and combined into one
score for every document.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Features of the content and of the metadata view.
SIZES = (1 << 14, 1 << 10)
#: Labelled documents that the models are fitted on (the least by a hash of the id); this is what is broadcast.
MAX_LABELLED = 100_000
ROUNDS = 2
#: Probabilities from which a view hands a document to the other one.
SURE_GOOD, SURE_BAD = 0.98, 0.05
#: Share of good held-out documents that the threshold has to keep.
KEEP_GOOD = 0.995
BINS, REACH = 512, 8.0
SYMBOLS = "#*$%&|<>"


def content_features(text: str) -> np.ndarray:
    words = set(text.encode("utf-8", "replace").lower().split())
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, count=len(words)) % SIZES[0]).astype(np.int32)


def metadata_features(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed properties: language, source, size, lines, and shares of symbols, digits and spaces."""
    size = len(text)
    share = lambda n: round(math.sqrt(n / max(size, 1)) * 20)
    lines = text.count("\n") + 1
    seen = [
        f"lang={lang}",
        f"source={source}",
        f"size={(size if n_chars is None else n_chars).bit_length()}",
        f"lines={lines.bit_length()}",
        f"line={(size // lines).bit_length()}",
        f"symbols={share(sum(map(text.count, SYMBOLS)))}",
        f"digits={share(sum(map(text.count, '0123456789')))}",
        f"spaces={share(text.count(' '))}",
    ]
    return np.unique([zlib.crc32(x.encode("utf-8", "replace")) % SIZES[1] for x in seen]).astype(np.int32)


@dataclass
class View:
    """Log-odds of each feature, and the calibration of their mean."""

    weights: np.ndarray
    scale: float = 1.0
    offset: float = 0.0

    def means(self, lists: pa.ListArray) -> np.ndarray:
        offsets = np.asarray(lists.offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[np.asarray(lists.values)[offsets[0] : offsets[-1]]])])
        return np.diff(sums[offsets - offsets[0]]) / np.maximum(np.diff(offsets), 1)

    def logits(self, lists: pa.ListArray) -> np.ndarray:
        return np.clip(self.scale * self.means(lists) + self.offset, -30, 30)


@dataclass
class Models:
    views: list[View]
    prior: float = 0.0
    threshold: float = 0.5
    told: list[int] = field(default_factory=list)

    def combined(self, lists: list[pa.ListArray]) -> np.ndarray:
        """Probability from both calibrated views, whose common prior counts once."""
        return _sigmoid(np.clip(sum(v.logits(x) for v, x in zip(self.views, lists, strict=True)) - self.prior, -30, 30))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def featurized(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str) -> DataFrame:
    """(id, label, held, content, layout) of every document; label is null if unknown."""
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED).withColumnRenamed("id", "_known")
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), F.col(source_col), F.col(size_col).cast("bigint"))
    rows = rows.join(F.broadcast(known), F.col(id_col) == F.col("_known"), "left").withColumn("_held", F.pmod(F.xxhash64("_known"), F.lit(4)) == 0).drop("_known")

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, langs, sources, sizes = (batch.column(k).to_pylist() for k in range(1, 5))
                content = [content_features(t or "") for t in texts]
                layout = [metadata_features(t or "", *meta) for t, *meta in zip(texts, langs, sources, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(6), lists(content), lists(layout)], names=["id", "label", "held", "content", "layout"])

    return rows.mapInArrow(run, f"id {kind}, label int, held boolean, content array<int>, layout array<int>")


def _counted(rows: DataFrame, classes) -> list[np.ndarray]:
    """Sums over all rows of the feature counts of each view: arrays (class, feature).

    ``classes(batch)`` gives two arrays with each row's class per view (-1:
    none). The last column counts rows. Counts of a partition are summed before
    they leave it, so at most 4 * sum(SIZES) numbers per partition do.
    """

    def run(batches):
        totals = [np.zeros((2, n + 1), np.int64) for n in SIZES]
        for batch in batches:
            for view, (total, classed) in enumerate(zip(totals, classes(batch), strict=True)):
                lists = batch.column(2 + view)
                offsets = np.asarray(lists.offsets)
                ids = np.asarray(lists.values)[offsets[0] : offsets[-1]]
                spread = np.repeat(classed, np.diff(offsets))
                for k in range(2):
                    total[k, :-1] += np.bincount(ids[spread == k], minlength=SIZES[view])
                    total[k, -1] += int((classed == k).sum())
        place = [(view, k, f, int(total[k, f])) for view, total in enumerate(totals) for k in range(2) for f in np.flatnonzero(total[k])]
        columns = list(zip(*place, strict=True)) if place else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["view", "class", "feature", "n"])

    found = rows.select("label", "held", "content", "layout").mapInArrow(run, "view int, class int, feature int, n bigint")
    totals = [np.zeros((2, n + 1)) for n in SIZES]
    for view, k, f, n in found.groupBy("view", "class", "feature").agg(F.sum("n")).collect():
        totals[view][k, f] = n
    return totals


def _weights(total: np.ndarray) -> np.ndarray:
    bad, good = total
    return np.log((good[:-1] + 1) / (good[-1] + 2)) - np.log((bad[:-1] + 1) / (bad[-1] + 2))


def _platt(bins: np.ndarray, values: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic fit to (class, bin) counts, by Newton's method with a small ridge."""
    if not (bins[0].sum() and bins[1].sum()):
        return 1.0, 0.0
    x = np.stack([values, np.ones_like(values)], axis=1)
    beta, ridge = np.array([1.0, 0.0]), np.diag([1e-2, 1e-3])
    total = bins.sum(axis=0)
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        gradient = x.T @ (bins[1] - total * p) - ridge @ (beta - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (total * p * (1 - p))[:, None]) + ridge, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _held_bins(rows: DataFrame, score) -> np.ndarray:
    """Counts (view, class, bin) of ``score(lists)`` over held-out labelled rows."""

    def run(batches):
        for batch in batches:
            label = np.asarray(batch.column(0)).astype(np.int64)
            for view, values in enumerate(score([batch.column(2), batch.column(3)])):
                place = np.clip(((values + REACH) / (2 * REACH) * BINS).astype(np.int64), 0, BINS - 1)
                n = np.bincount(label * BINS + place, minlength=2 * BINS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["view", "at", "n"])

    found = rows.filter("held").select("label", "held", "content", "layout").mapInArrow(run, "view int, at int, n bigint")
    out = np.zeros((2, 2, BINS))
    for view, at, n in found.groupBy("view", "at").agg(F.sum("n")).collect():
        out[view, at // BINS, at % BINS] = n
    return out


def _fitted(rows: DataFrame, totals: list[np.ndarray]) -> Models:
    views = [View(_weights(t)) for t in totals]
    centres = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    held = _held_bins(rows, lambda lists: [v.means(x) for v, x in zip(views, lists, strict=True)])
    for view, bins in zip(views, held, strict=True):
        view.scale, view.offset = _platt(bins, centres)
    good = held[0, 1].sum()
    prior = math.log((good + 1) / (held[0, 0].sum() + 1)) if good else 0.0
    return Models(views, prior)


def train(rows: DataFrame, rounds: int = ROUNDS) -> Models:
    """Models after ``rounds`` exchanges of pseudo-labels over all of ``rows``."""
    known = rows.filter("label is not null")
    first = _counted(known.filter("not held"), lambda batch: [np.asarray(batch.column(0)).astype(np.int64)] * 2)
    models, told = _fitted(known, first), []
    for _ in range(rounds):

        def handed(batch, views=models.views):
            sure = []
            for view, lists in zip(views, (batch.column(2), batch.column(3)), strict=True):
                p = _sigmoid(view.logits(lists))
                sure.append(np.where(p >= SURE_GOOD, 1, np.where(p <= SURE_BAD, 0, -1)))
            return [sure[1], sure[0]]

        more = _counted(rows.filter("label is null"), handed)
        told.append(int(sum(m[:, -1].sum() for m in more)))
        models = _fitted(known, [a + b for a, b in zip(first, more, strict=True)])
    logit = lambda p: np.log(p / (1 - p))
    good = _held_bins(known, lambda lists: [np.clip(logit(np.clip(models.combined(lists), 1e-9, 1 - 1e-9)), -REACH, REACH)])[0, 1]
    if good.sum():
        below = np.cumsum(good) - good
        place = int(np.flatnonzero(below <= (1 - KEEP_GOOD) * good.sum())[-1])
        models.threshold = min(0.5, float(_sigmoid(np.array(place / BINS * 2 * REACH - REACH))))
    models.told = told
    return models


def classify(docs: DataFrame, labels: DataFrame, *, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """Per row of ``docs``: id, p_content, p_metadata, score, kept.

    ``labels`` has id and label (1 good, 0 bad); null labels are no labels, of
    repeated ids the higher label counts. Null texts count as empty and null
    metadata as a value of its own; null ids are scored but never labelled;
    repeated rows are scored alike; other columns are ignored; an empty table
    gives an empty table. Without labels of both classes every view gives its
    uncalibrated score. No text is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = staged(featurized(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, size_col=size_col), "cotrain-features")
    models = train(rows, rounds)

    def run(batches):
        for batch in batches:
            lists = [batch.column(1), batch.column(2)]
            each = [_sigmoid(v.logits(x)) for v, x in zip(models.views, lists, strict=True)]
            score = models.combined(lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(x, 6)) for x in (*each, score)), pa.array(score >= models.threshold)], names=[id_col, "p_content", "p_metadata", "score", "kept"])

    return rows.select("id", "content", "layout").mapInArrow(run, f"{id_col} {kind}, p_content double, p_metadata double, score double, kept boolean")
