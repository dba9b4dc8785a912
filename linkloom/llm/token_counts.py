"""Token counts of subword-piece models without emitting identifiers.

A text's count is its number of initial symbols minus the number of merges.
Merges run over a heap of adjacent pairs (lowest rank first, leftmost first)
and a doubly linked list of symbols. No merge can cross two neighbouring
characters that are neighbours in no piece of the vocabulary, so texts fall
apart into short chunks, each of which is merged once per worker and then
remembered in a dictionary of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunks in one generation of a Python worker's memory.
MEMO_ENTRIES = 500_000

#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one serialized protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 1:
            value, i = data[i : i + 8], i + 8
        elif wire == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif wire == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        else:
            raise ValueError(f"wire type {wire} in the model file")
        yield tag >> 3, value


class _Memo(dict):
    """A dictionary that computes missing values, in two generations.

    Keys of over 40 characters are never stored.
    When the young one is full it becomes the old one, from which values in
    use move back, so frequent keys stay and at most twice MEMO_ENTRIES exist.
    """

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(key) > 40:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCounter:
    """Counts tokens as a byte-fallback BPE piece model gives them.

    Supports models with the identity normalizer, kept white space and byte
    pieces; others are refused with ValueError rather than counted wrongly.
    """

    def __init__(self, model: bytes):
        pieces, normalizer = [], {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only identity normalizers that keep white space are supported")
        if any(kind == USER_DEFINED for _, _, kind in pieces) or sum(kind == BYTE for _, _, kind in pieces) != 256:
            raise ValueError("only models with byte fallback and no user-defined pieces are supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        normal = {text: score for text, score, kind in pieces if kind in (NORMAL, UNUSED)}
        order = {score: rank for rank, score in enumerate(sorted(set(normal.values()), reverse=True))}
        self.rank = {text: order[score] for text, score in normal.items() if len(text) > 1}
        self.single = {text for text in normal if len(text) == 1}
        if any(c not in self.single for text in self.rank for c in text):
            raise ValueError("a piece holds a character that is no piece itself")
        self.neighbours = {text[i : i + 2] for text in self.rank for i in range(len(text) - 1)}
        #: Lines and single spaces can be cut off without a look at the text.
        self.lines_apart = not any("\n" in pair for pair in self.neighbours)
        self.words_apart = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.neighbours)
        self.line_break = self.symbols("\n")
        self.bare = _Memo(self.chunk)
        self.spaced = _Memo(lambda word: self.chunk(SPACE + word))
        self.parts = _Memo(lambda part: self.symbols(part) - self.merges(part))

    def symbols(self, text: str) -> int:
        """Initial symbols: a known character is one, any other one per byte."""
        single = self.single
        return sum(1 if c in single else len(c.encode()) for c in text)

    def merges(self, text: str) -> int:
        """How many merges the model does inside ``text``."""
        n, rank = len(text), self.rank
        if n < 2:
            return 0
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        # a symbol is named by its start; stop leads to the next one (0: merged away), before to the one in front
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            _, left, end = pop(heap)
            right = stop[left]
            if not right or right >= n or stop[right] != end:
                continue
            done += 1
            stop[left], stop[right] = end, 0
            if end < n:
                before[end] = left
                if (r := rank.get(text[left : stop[end]])) is not None:
                    push(heap, (r, left, stop[end]))
            if (prior := before[left]) >= 0 and (r := rank.get(text[prior:end])) is not None:
                push(heap, (r, prior, end))
        return done

    def chunk(self, text: str) -> int:
        """Tokens of a stretch of normalized text."""
        total, begin, neighbours = 0, 0, self.neighbours
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in neighbours:
                total += self.parts[text[begin:i]]
                begin = i
        return total + (self.parts[text[begin:]] if text else 0)

    def count(self, text: str) -> int:
        """Tokens of a whole text; 0 for an empty one."""
        if not text:
            return 0
        if not (self.lines_apart and self.words_apart) or SPACE in text:
            return self.chunk((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))
        lines = text.split("\n")
        total, first = self.line_break * (len(lines) - 1), self.dummy_prefix
        bare, spaced, runs = self.bare, self.spaced, "  " in text
        for line in lines:
            if runs and "  " in line or first and line[:1] == " ":
                total += self.chunk((SPACE if first else "") + line.replace(" ", SPACE))
            else:
                words = line.split(" ")
                if not first:
                    head = words.pop(0)
                    total += bare[head] if head else 0
                total += sum(map(spaced.__getitem__, words))
            first = False
        return total


@functools.lru_cache(maxsize=2)
def _counter(model: bytes) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``model`` is the content of the piece-model file (about half a megabyte),
    which travels with the task. Null texts count as empty (0 bytes, 0 tokens),
    null ids and repeated rows are kept as they are, other columns are ignored,
    an empty table gives an empty table. Memory is bounded by one Arrow batch
    plus the worker's memo, whatever the number or skew of rows.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches):
        counter = _counter(model)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
