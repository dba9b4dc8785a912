"""Toxicity by compression distance: two zstandard dictionaries compared window by window.

Labelled documents train two dictionaries: one of pieces of words that toxic
documents hold much more often than ordinary ones (by the G statistic of their
document counts), one of the words of ordinary documents. A window is a word of
a text, repeated REPEATS times, since zstandard leaves shorter input as it is.
Where the toxic dictionary compresses it by k bytes better, the window counts
for the difference k. How many windows of a document reach each difference is
all that its score sees; a logistic fit on labelled documents that the
dictionaries have not seen calibrates these thresholds.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: Labelled documents of each class that the model is fitted on at most (the least by a hash of the id).
MAX_PER_CLASS = 5_000
#: Of each four of them one calibrates and the others train the dictionaries.
CALIBRATE = 4
#: A window repeats its word so often; words beyond LONG_WORD characters are cut into such windows.
REPEATS, LONG_WORD = 4, 64
#: Lengths in characters (with the space in front) of a word's beginnings that are counted besides the word itself.
PIECES = range(5, 13)
#: A piece is toxic if its share is so many times that of ordinary documents, and its G statistic at least this.
TIMES, LEAST_G, LEAST_DOCS = 3.0, 25.0, 3
#: Pieces of a dictionary at most, the strongest first.
MAX_PIECES = 3_000
LEVEL = 15
#: Differences in bytes are counted from -LOW to HIGH, those beyond at the end.
LOW, HIGH = 8, 15
#: Windows in a worker's memory.
MEMO_ENTRIES = 400_000
RIDGE = 0.5

_WORDS = re.compile(r"\w+")


def words(text: str | None):
    """The windows' words: runs of letters, digits and underscores in lower case, long ones cut."""
    for found in _WORDS.finditer((text or "").lower()):
        word = found[0]
        if len(word) <= LONG_WORD:
            yield word
        else:
            for begin in range(0, len(word), LONG_WORD):
                yield word[begin : begin + LONG_WORD]


def pieces(text: str | None) -> set[str]:
    """What is counted once per document: every word between spaces, and its beginnings."""
    found = set()
    for word in set(words(text)):
        marked = f" {word} "
        found.add(marked)
        found.update(marked[:n] for n in PIECES if n < len(marked))
    return found


def g_statistic(a: int, na: int, b: int, nb: int) -> float:
    """How far ``a`` of ``na`` and ``b`` of ``nb`` are from equal shares."""
    share = (a + b) / (na + nb)

    def part(k: int, n: int) -> float:
        return (k * math.log(k / (n * share)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - share))) if n - k else 0.0)

    return 2 * (part(a, na) + part(b, nb))


def toxic_pieces(counted: list[tuple[str, int, int]], n_toxic: int, n_ordinary: int) -> list[str]:
    """The telling pieces of (piece, toxic documents, ordinary documents), strongest first.

    A beginning goes if a stronger piece begins with it, a longer piece if it
    is less than half as strong as a beginning of it that is kept.
    """
    ranked = sorted(((g_statistic(a, n_toxic, b, n_ordinary), piece) for piece, a, b in counted), key=lambda x: (-x[0], -len(x[1]), x[1]))
    kept: dict[str, float] = {}
    covered: set[str] = set()
    for strength, piece in ranked:
        if strength < LEAST_G or len(kept) >= MAX_PIECES or piece in covered:
            continue
        shorter = [kept[piece[:n]] for n in range(1, len(piece)) if piece[:n] in kept]
        if shorter and strength < 0.5 * max(shorter):
            continue
        kept[piece] = strength
        covered.update(piece[:n] for n in range(1, len(piece)))
    return list(kept)


@dataclass(frozen=True)
class Dictionaries:
    """Contents of the two dictionaries; the strongest pieces stand last, where they are cheapest to name."""

    toxic: bytes
    ordinary: bytes

    def differences(self):
        """A function from a word to the bytes that the toxic dictionary saves over the ordinary one."""
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

        def compressor(content: bytes):
            # a raw dictionary needs eight bytes
            data = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)

        toxic, ordinary = compressor(self.toxic), compressor(self.ordinary)

        def difference(word: str) -> int:
            window = (f" {word}" * REPEATS + " ").encode("utf-8", "replace")
            return len(ordinary.compress(window)) - len(toxic.compress(window))

        return difference


@functools.lru_cache(maxsize=2)
def _memo(dictionaries: Dictionaries) -> tuple[dict, object]:
    return {}, dictionaries.differences()


def profile(text: str | None, dictionaries: Dictionaries) -> list[int]:
    """How many windows of ``text`` have each difference from -LOW to HIGH."""
    memo, difference = _memo(dictionaries)
    counts = [0] * (LOW + HIGH + 1)
    for word, n in Counter(words(text)).items():
        place = memo.get(word)
        if place is None:
            place = min(max(difference(word), -LOW), HIGH) + LOW
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[word] = place
        counts[place] += n
    return counts


def features(profiles: np.ndarray) -> np.ndarray:
    """Per document: how many windows reach each difference from 1 on (log, and as a share), and the number of windows (log)."""
    total = profiles.sum(axis=1, keepdims=True).astype(float)
    reach = profiles[:, ::-1].cumsum(axis=1)[:, ::-1][:, LOW + 1 :]
    return np.hstack([np.log1p(reach), reach / np.maximum(total, 1) * 20, np.log1p(total), np.ones((len(profiles), 1))])


@dataclass
class Model:
    dictionaries: Dictionaries
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def scores(self, profiles: np.ndarray) -> np.ndarray:
        # summed row by row, so that equal texts score alike whatever rows stand beside them
        logits = ((features(profiles) - self.centre) / self.spread * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def calibrated(dictionaries: Dictionaries, profiles: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """A logistic fit by Newton's method with a ridge; ``weights`` are what each document stands for."""
    raw = features(profiles)
    centre, spread = raw.mean(axis=0) if len(raw) else np.zeros(raw.shape[1]), raw.std(axis=0) + 1e-9 if len(raw) else np.ones(raw.shape[1])
    centre[-1], spread[-1] = 0.0, 1.0
    x = (raw - centre) / spread
    beta, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (weights * p * (1 - p))) @ x + ridge, x.T @ (weights * (labels - p)) - ridge @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Model(dictionaries, beta, centre, spread)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS) -> Model:
    """The model of labelled documents; ``labels`` has id and label (1 toxic, 0 ordinary).

    Per class at most ``max_per_class`` labels are used, the least by a hash of
    the id; classes weigh by their true counts. Without either class the
    dictionaries are empty and every score is the share of toxic labels.
    """
    known = staged(labels.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("int").alias("label")), "toxic-labels")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for k in (0, 1)]
    drawn = picked[0].union(picked[1]).select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    # at most twice max_per_class ids: a bounded broadcast
    sample = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("_id")).select("id", F.col("_label").alias("label"), "text"), "toxic-sample")

    def calibrating(id_) -> bool:
        return zlib.crc32(f"calibrate:{id_}".encode()) % CALIBRATE == 0

    def count(batches):
        counts: dict[str, list[int]] = {}
        totals = [0, 0]
        for batch in batches:
            for id_, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if calibrating(id_):
                    continue
                totals[label] += 1
                for piece in pieces(text):
                    counts.setdefault(piece, [0, 0])[label] += 1
            while len(counts) >= 1 << 16:
                some = [counts.popitem() for _ in range(1 << 14)]
                yield _counts(some)
        yield _counts([*counts.items(), (None, totals)])

    def _counts(items):
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in items], pa.string()), *(pa.array([c[k] for _, c in items], pa.int64()) for k in (1, 0))], names=["piece", "toxic", "ordinary"])

    counted = staged(sample.mapInArrow(lean(count), "piece string, toxic bigint, ordinary bigint").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxic-pieces")
    totals = counted.filter("piece is null").first()
    n_toxic, n_ordinary = (totals["toxic"], totals["ordinary"]) if totals else (0, 0)
    telling, common = [], []
    if n_toxic and n_ordinary:
        # a candidate is in LEAST_DOCS documents and TIMES as frequent; only the most frequent ones come to the driver
        often = counted.filter(F.col("piece").isNotNull() & (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * F.lit(float(n_ordinary)) > F.col("ordinary") * F.lit(TIMES * n_toxic)))
        rows = often.orderBy(F.desc("toxic"), "ordinary", "piece").limit(20 * MAX_PIECES).collect()
        telling = toxic_pieces([(r["piece"], r["toxic"], r["ordinary"]) for r in rows], n_toxic, n_ordinary)
        plain = counted.filter(F.col("piece").endswith(" ") & (F.length("piece") > 2)).orderBy(F.desc("ordinary"), "piece").limit(MAX_PIECES).collect()
        named = set(telling)
        common = [r["piece"] for r in plain if r["piece"] not in named and r["ordinary"]]
    dictionaries = Dictionaries("".join(reversed(telling)).encode("utf-8", "replace"), "".join(reversed(common)).encode("utf-8", "replace"))

    def measure(batches):
        for batch in batches:
            rows = [(label, profile(text, dictionaries)) for id_, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if calibrating(id_)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["label", "profile"])

    measured = sorted((r["label"], tuple(r["profile"])) for r in sample.mapInArrow(lean(measure), "label int, profile array<bigint>").collect())
    found = np.array([r[0] for r in measured], float)
    stands = np.array([sizes.get(k, 0) / max(1, int((found == k).sum())) for k in (0, 1)])
    # the weights keep the classes' shares and sum to the number of documents, so that the ridge means the same at any size
    weights = stands[found.astype(int)] * (len(found) / max(1, sum(sizes.get(k, 0) for k in (0, 1))))
    return calibrated(dictionaries, np.array([r[1] for r in measured], np.int64).reshape(-1, LOW + HIGH + 1), found, weights)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: id, score (0 to 1), predicted (1 if the score is at least ``threshold``).

    Null and wordless texts have no windows and are scored all the same; null
    labels are no labels, of repeated ids the higher label counts; null ids are
    scored but never learned from; repeated rows are scored alike; other columns
    are ignored; an empty table gives an empty table. Only the text is scored,
    the whole of it, word by word.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, max_per_class=max_per_class)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                profiles = np.array([profile(t.as_py(), model.dictionaries) for t in batch.column(1)], np.int64).reshape(-1, LOW + HIGH + 1)
                score = model.scores(profiles)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, score double, predicted int")
