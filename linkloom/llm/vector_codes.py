"""Product codes of vectors: integer codebooks by Elkan's form of Lloyd's rounds.

A vector is cut into equal parts; each part position has a codebook, and a
code is the nearest entry of each part. Between rounds every row keeps, per
part, its entry, one upper bound (distance to it) and one lower bound for each
entry. Before a round the bounds are shifted by how far entries moved; an entry
whose lower bound, or half of whose distance to the row's entry, is strictly
above the upper bound can neither win nor tie. All others are compared by exact
integer distances. Bounds only ever err to the safe side, so the codes are
those of the plain rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, staged

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows that are compared at once.
BLOCK = 2048
#: The largest number that a long can hold.
MOST = (1 << 63) - 1
#: Share of this or more of all rows: such labels, fewer than its inverse, are joined by a broadcast.
HOT_SHARE = 0.001
#: Relative slack that covers rounding of square roots and sums of doubles.
SLACK = 1e-12


def _small(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of the arrays are exact in doubles."""
    most = max((int(abs(int(a.max(initial=0)))) if a.max(initial=0) > -a.min(initial=0) else abs(int(a.min(initial=0))) for a in arrays), default=0)
    return arrays[0].shape[1] * (2 * most) ** 2 < 1 << 52


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry) of integer vectors: doubles if they hold them, else Python's integers."""
    if _small(x, c):
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    x, c = x.astype(object), c.astype(object)
    return np.stack([((row - c) ** 2).sum(1) for row in x]) if len(x) else np.zeros((0, len(c)), object)


def _pairs(x: np.ndarray, c: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of listed (row, entry) pairs."""
    kind = np.float64 if _small(x, c) else object
    difference = x[rows].astype(kind) - c[entries].astype(kind)
    return (difference * difference).sum(1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def below(bounds: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are not above ``bounds``."""
    capped = np.minimum(bounds, 65504.0)
    half = capped.astype(np.float16)
    return np.where(half > capped, np.nextafter(half, np.float16(-np.inf)), half)


def above(bounds: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not below ``bounds``."""
    return np.nextafter(bounds.astype(np.float32), np.float32(np.inf))


def first(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of rows that nothing is known of; of equally near entries the lowest."""
    squares = distances(x, c)
    entry = np.argmin(squares, axis=1) if len(x) else np.zeros(0, np.int64)
    roots = _root(squares)
    return entry, roots[np.arange(len(x)), entry] * (1 + SLACK), roots * (1 - SLACK)


def again(x: np.ndarray, c: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, number of distances) after entries ``moved`` this far.

    ``half`` is half the distance of each two entries. Bounds are shifted
    first; a pair is compared only where neither test excludes it strictly.
    """
    entry = entry.copy()
    upper = upper.astype(np.float64) + moved[entry]
    lower = np.maximum(lower.astype(np.float64) - moved[None, :], 0.0) * (1 - SLACK)
    every = np.arange(len(x))

    def open_pairs(rows: np.ndarray) -> np.ndarray:
        own = entry[rows]
        possible = (lower[rows] <= upper[rows, None]) & (half[own] <= upper[rows, None])
        possible[np.arange(len(rows)), own] = False
        return possible

    rows = every[open_pairs(every).any(axis=1)]
    own = _pairs(x, c, rows, entry[rows])
    roots = _root(own)
    upper[rows], lower[rows, entry[rows]] = roots * (1 + SLACK), roots * (1 - SLACK)
    possible = open_pairs(rows)
    at, entries = np.nonzero(possible)
    squares = _pairs(x, c, rows[at], entries)
    lower[rows[at], entries] = _root(squares) * (1 - SLACK)
    best, chosen = own.copy(), entry[rows].copy()
    if len(at):
        # of each row the least distance, of equal ones the lowest entry; the own entry competes as well
        table = np.full(possible.shape, np.inf, dtype=squares.dtype if squares.dtype == object else np.float64)
        table[at, entries] = squares
        table[np.arange(len(rows)), chosen] = own
        chosen = np.argmin(table, axis=1)
        best = table[np.arange(len(rows)), chosen]
    entry[rows] = chosen
    upper[rows] = _root(best) * (1 + SLACK)
    return entry, upper, lower, len(rows) + len(at)


class Codebooks:
    """One integer codebook for each part position: array (part, entry, place)."""

    def __init__(self, entries: np.ndarray, before: Codebooks | None = None):
        self.entries = entries
        self.moved = self.half = None
        if before is not None:
            self.moved = [np.array([_root(_pairs(old[i : i + 1], new[i : i + 1], np.zeros(1, int), np.zeros(1, int)))[0] for i in range(len(new))]) * (1 + SLACK) for old, new in zip(before.entries, entries, strict=True)]
            self.half = [_root(distances(c, c)) * (0.5 * (1 - SLACK)) for c in entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def replaced(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each entry as the rounded-down mean of its parts; unused ones stay."""
        fresh = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            fresh[part, entry] = [int(t) // n for t in total]
        return Codebooks(fresh, self)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (id, label, v and, after the first round, entry, upper, lower) with the nearest entries of ``books``."""
    parts, k, width = books.entries.shape
    known = "entry" in rows.columns

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                n = batch.num_rows
                x = _matrix(batch.column(2), parts * width).reshape(n, parts, width)
                entry, upper, lower = np.zeros((n, parts), np.int32), np.zeros((n, parts), np.float32), np.zeros((n, parts, k), np.float16)
                if known:
                    was = _matrix(batch.column(3), parts)
                    bounds = [np.frombuffer(b"".join(batch.column(i).to_pylist()), t) for i, t in ((4, "<f4"), (5, "<f2"))]
                    uppers, lowers = bounds[0].reshape(n, parts), bounds[1].reshape(n, parts, k)
                for p in range(parts):
                    if known:
                        found = again(x[:, p], books.entries[p], was[:, p], uppers[:, p], lowers[:, p], books.moved[p], books.half[p])[:3]
                    else:
                        found = first(x[:, p], books.entries[p])
                    entry[:, p], upper[:, p], lower[:, p] = found[0], above(found[1]), below(found[2])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), _lists(entry, pa.int32()), _bytes(upper.astype("<f4")), _bytes(lower.astype("<f2"))],
                    names=["id", "label", "v", "entry", "upper", "lower"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(lean(run), f"id {kinds['id']}, label {kinds['label']}, v array<bigint>, entry array<int>, upper binary, lower binary")


def summed(rows: DataFrame, shape: tuple[int, int, int]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts of every used entry; summed per partition before the shuffle."""
    parts, k, width = shape

    def run(batches):
        counts, totals = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for batch in batches:
            x, entry = _matrix(batch.column(0), parts * width).reshape(-1, parts, width), _matrix(batch.column(1), parts)
            kind = np.int64 if int(np.abs(x.astype(float)).max(initial=0)) < 1 << 40 else object
            for p in range(parts):
                counts[p] += np.bincount(entry[:, p], minlength=k)
                part = np.zeros((k, width), kind)
                np.add.at(part, entry[:, p], x[:, p].astype(kind))
                totals[p] += part
        for p, e in zip(*np.nonzero(counts), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p)], pa.int32()), pa.array([int(e)], pa.int32()), pa.array([int(counts[p, e])], pa.int64()), pa.array([[int(t) for t in totals[p, e]]], pa.list_(pa.decimal128(38, 0)))],
                names=["part", "entry", "n", "total"],
            )

    found = rows.select("v", "entry").mapInArrow(lean(run), "part int, entry int, n bigint, total array<decimal(38,0)>")
    per = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))).cast("decimal(38,0)") for i in range(width))).alias("total"))
    return {(r["part"], r["entry"]): (r["n"], [int(t) for t in r["total"]]) for r in per.collect()}


def _coded(rows: DataFrame, books: Codebooks, id_col: str) -> DataFrame:
    """(id, label, code, error) of rows that have their entries."""
    parts, _, width = books.entries.shape

    def run(batches):
        for batch in batches:
            x, entry = _matrix(batch.column(2), parts * width).reshape(-1, parts, width), _matrix(batch.column(3), parts)
            every = np.arange(len(x))
            squares = [_pairs(x[:, p], books.entries[p], every, entry[:, p]) for p in range(parts)]
            error = [min(MOST, sum(int(s) for s in row)) for row in zip(*squares, strict=True)]
            code = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[id_col, "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("id", "label", "v", "entry").mapInArrow(lean(run), f"{id_col} {kinds['id']}, label {kinds['label']}, code string, error bigint")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the error summed over rows of the same label (nulls together, at most what a long holds).

    Labels that hold at least HOT_SHARE of all rows are fewer than its inverse
    and are broadcast; the others meet their sums in a shuffle without hot keys.
    """
    sums = staged(rows.groupBy("label").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "vector-labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.filter(F.col("n") >= HOT_SHARE * total).select(F.col("label").alias("_label"), F.col("label_error"))
    rest = sums.filter(F.col("n") < HOT_SHARE * total).select(F.col("label").alias("_label"), F.col("label_error").alias("_rest"))
    marked = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    common, rare = marked.filter("label_error is not null"), marked.filter("label_error is null").drop("label_error")
    return common.unionByName(rare.join(rest, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumnRenamed("_rest", "label_error"))


def encode(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Components become floor(scale * x), x as double; one beyond a long counts
    as its end. Codebooks begin as the parts of the ``entries`` least ids (null
    ids last, equal ids by their vectors; fewer rows give fewer entries), and
    each round moves every used entry to the rounded-down mean of its parts.
    Rows with a null vector or a null or non-finite component take no part;
    neither do vectors that are not as long as the first one, or whose length
    is no positive multiple of ``parts``. Repeated rows count as often as they come;
    null ids and labels are kept; other columns are ignored; an empty table
    gives an empty table. Errors beyond a long count as its end. Only the
    codebooks, entries x components numbers, are held by the driver and sent along.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: entries must be between 1 and 256")
    sound = (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    numbers = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = staged(vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), numbers.alias("v")), "vector-rows")
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    size = len(start[0]["v"]) if start else parts
    if rows.filter(F.size("v") != size).limit(1).count():
        rows = rows.filter(F.size("v") == size)
        start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = Codebooks(np.array([r["v"] for r in start] or [[0] * size], np.int64).reshape(-1, parts, size // parts).transpose(1, 0, 2).copy())
    state = None
    for _ in range(rounds):
        fresh = staged(assigned(rows if state is None else state, books), "vector-bounds")
        if state is not None:
            discard(state)
        state = fresh
        books = books.replaced(summed(state, books.entries.shape))
    final = staged(_coded(assigned(rows if state is None else state, books), books, id_col), "vector-codes")
    if state is not None:
        discard(state)
    named = with_label_error(final)
    return named.select(id_col, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
