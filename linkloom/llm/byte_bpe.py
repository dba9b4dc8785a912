"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are split into words in Python, which hands every distinct word of a
partition to the JVM once, as an array of its bytes, in rows of many words,
followed by the documents as arrays of word numbers. Words that are frequent in
a bounded sample are folded once ahead and known to all partitions, which saves
time and changes nothing else. A higher-order fold merges each word: the pair
of the lowest rank, the leftmost of equals, until no neighbours form a token.
Ranks come from a map of token pairs that each row of words brings along as
columns; as literals it filled the driver with copies. Decoding concatenates
the binary pieces of a word's ids. A second Python step puts documents together
again; as rows of a partition keep their order, nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import random
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LATIN_WORDS, give_back, lean, staged

#: Distinct words after which a partition starts a new dictionary.
MAX_WORDS = 300_000
#: Longer words (bytes) are merged over a heap in Python: the fold takes time with the square of the length.
FOLD_BYTES = 1024
#: Words that are folded once ahead because they are frequent, their length in bytes, and the documents in which they are counted.
MAX_FREQUENT, FREQUENT_BYTES, SAMPLE_DOCS = 250_000, 64, 50_000
#: Words, bytes of them, and bytes of word numbers after which a row is full.
ROW_WORDS, ROW_BYTES, ROW_CODES = 8192, 1 << 20, 1 << 22
#: Characters of a plan's text that Spark keeps, as the driver keeps the texts of all plans that ran.
PLAN_TEXT = 1 << 16
#: Longer texts are split piece by piece instead of all at once.
LONG = 1 << 20

# The usual splitting pattern of byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE = re.compile("[^\\x00-\\xff]")
_PLAIN = re.compile(LATIN_WORDS)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@functools.lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def words_of(text: str, pattern: str = PATTERN):
    """The matches of ``pattern`` in ``text``, in order."""
    split = _PLAIN if pattern == PATTERN and not _WIDE.search(text) else _pattern(pattern)
    return split.findall(text) if len(text) <= LONG else (m[0] for m in split.finditer(text))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word, merged over a heap of its adjacent pairs."""
    n = len(word)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, end = heapq.heappop(heap)
        right = stop[left]
        if not right or right >= n or stop[right] != end:
            continue
        stop[left], stop[right] = end, 0
        if end < n:
            before[end] = left
            if (r := ranks.get(word[left : stop[end]])) is not None:
                heapq.heappush(heap, (r, left, stop[end]))
        if (prior := before[left]) >= 0 and (r := ranks.get(word[prior:end])) is not None:
            heapq.heappush(heap, (r, prior, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : stop[at]]])
        at = stop[at]
    return ids


class Numbers(dict):
    """Words by number; a word that is asked for the first time gets the next one and waits in ``fresh``."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number


@dataclass
class RankMap:
    """All pairs of tokens that form a token, as arrays.

    The pair (a, b) is looked up at place ``shift[a] + b`` of ``slots``, where
    it is found as a * SPAN + rank, shifted to RANK_AT, if it exists. Rows of
    different a are shifted so that their entries do not meet. ``starts`` has
    the id of each byte, ``end`` is an id that pairs with nothing.
    """

    shift: np.ndarray
    slots: np.ndarray
    starts: np.ndarray
    end: int
    SPAN = 1 << 17
    #: What rows of words bring along: the three arrays, and all pieces by id in hexadecimal digits.
    KINDS = "shift array<bigint>, slots array<bigint>, starts array<bigint>, pieces array<string>"

    def columns(self, ranks: dict[bytes, int]) -> list[pa.Array]:
        """The values of KINDS."""
        by_id = [""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            by_id[i] = piece.hex()
        return [*(pa.array(x, pa.int64()) for x in (self.shift, self.slots, self.starts)), pa.array(by_id, pa.string())]

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> RankMap:
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, rank))
        width = max(ranks.values()) + 2
        taken = np.zeros(4 * sum(map(len, rows.values())) + 2 * width, bool)
        values = np.full(len(taken), NO_PAIR, np.int64)
        shift, draw = [0] * width, random.Random(0)
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            columns = np.array([b for b, _ in row])
            # large rows go first, while there is room; every draw is tried until nothing meets
            while taken[places := columns + draw.randrange(len(taken) - width)].any():
                pass
            taken[places] = True
            values[places] = [(a * cls.SPAN + rank) << RANK_AT for _, rank in row]
            shift[a] = int(places[0] - columns[0])
        return cls(np.array(shift), values, np.array([ranks[bytes([b])] for b in range(256)]), width - 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _let(value: Column, then) -> Column:
    """``then(value)`` with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


# A symbol of a word is one long: from bit RANK_AT on the rank that it forms with the next one (SPAN or more: none), then its place, then its id.
RANK_AT, PLACE_AT = 28, 17
_ID, _REST = (1 << PLACE_AT) - 1, (1 << RANK_AT) - 1
_PLACE = _REST - _ID
#: An empty slot, which differs from every a in its upper bits.
NO_PAIR = ((1 << 18) - 1) << (RANK_AT + 17)


#: Names of RankMap.KINDS.
TABLES = ("shift", "slots", "starts", "pieces")


def fold_merges(words: Column, end_id: int) -> Column:
    """Ids of words that are given as an array of arrays of their bytes, by the columns of a RankMap in the same row.

    The state is the array of symbols between two ends that pair with nothing.
    A symbol's number begins with the rank of its pair and goes on with its
    place, so the least one is the pair to merge next, the leftmost of equals.
    Every step of the fold merges one pair; a word of n bytes takes at most
    n - 1 of them.
    """
    end, far, none = _long(end_id), F.lit(1 << 29), _long(RankMap.SPAN << RANK_AT)

    def together(*parts: Column) -> Column:
        return F.flatten(F.array(*parts))

    def folded(tables: Column) -> Column:
        def pair(a: Column, b: Column) -> Column:
            # an entry of another row, or none, differs from a in its upper bits, so it is SPAN or more
            return F.get(tables["slots"], F.get(tables["shift"], a) + b).bitwiseXOR(F.shiftleft(a, RANK_AT + 17))

        def merged(state: Column, low: Column) -> Column:
            def at(i: Column) -> Column:
                left, right, fresh = F.get(state, i - 2), F.get(state, i + 1), F.shiftright(low, RANK_AT)
                before = pair(left.bitwiseAND(_long(_ID)), fresh).bitwiseOR(left.bitwiseAND(_long(_REST)))
                here = pair(fresh, right.bitwiseAND(_long(_ID))).bitwiseOR(low.bitwiseAND(_long(_PLACE))).bitwiseOR(fresh)
                return together(F.slice(state, F.lit(1), i - 2), F.array(before, here), F.slice(state, i + 2, far))

            return _let(F.array_position(state, low).cast("int"), at)

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state), lambda low: F.when(low < none, merged(state, low)).otherwise(state))

        def word(data: Column) -> Column:
            ids = together(F.array(end), F.transform(data, lambda b: F.get(tables["starts"], b)), F.array(end))
            symbol = lambda x: lambda a, i: pair(a, F.coalesce(F.get(x, i + 1), end)).bitwiseOR(F.shiftleft(i.cast("bigint"), PLACE_AT)).bitwiseOR(a)
            first = _let(ids, lambda x: F.transform(x, symbol(x)))
            return F.aggregate(F.slice(data, F.lit(2), far), first, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(_long(_ID)).cast("int")))

        return F.transform(words, word)

    return _let(F.struct("shift", "slots", "starts"), folded)


def id_texts(words: Column) -> Column:
    """Each array of ids in decimal digits, joined by commas."""
    return F.transform(words, lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").cast("binary"))


def decode_ids(words: Column, pieces: Column) -> Column:
    """The bytes of each array of ids: their binary pieces, one after the other."""
    return F.transform(words, lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def _listed(lists, kind: pa.DataType) -> pa.ListArray:
    """Lists or numpy arrays as one array of lists."""
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[0] if len(lists) == 1 else list(itertools.chain(*lists)), kind))


def _leading(values: pa.Array, others: int) -> pa.ListArray:
    """One row with all ``values`` and ``others`` empty ones."""
    return pa.ListArray.from_arrays(pa.array([0] + [len(values)] * (1 + others), pa.int32()), values)


def _byte_lists(data) -> pa.ListArray:
    """Arrays of the bytes of each element (null: null)."""
    sizes = np.fromiter((len(x or b"") for x in data), np.int32, count=len(data))
    numbers = np.frombuffer(b"".join(x or b"" for x in data), np.uint8).astype(np.int32)
    none = pa.array([x is None for x in data], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(numbers), mask=none)


def _frequent(texts: DataFrame, ranks: dict[bytes, int], rank_map: RankMap, pattern: str, most: int) -> pa.Table:
    """Frequent words (word) with the text of their ids (ids) and their decoded bytes (decoded).

    They are counted in SAMPLE_DOCS documents at most (all, if there are no
    more) and folded like any other word. At most ``most`` words of
    FREQUENT_BYTES bytes reach the driver and travel with the tasks. They only
    spare partitions the fold of these words; results are the same without them.
    """
    n = texts.count()
    sample = texts.sample(SAMPLE_DOCS / n, seed=42) if n > SAMPLE_DOCS else texts

    def count(batches):
        found: dict[str, int] = {}
        for batch in batches:
            for value in batch.column(0):
                for word in words_of(value.as_py() or "", pattern):
                    found[word] = found.get(word, 0) + 1
            if len(found) > MAX_WORDS:
                yield listed(found)
                found = {}
        yield listed(found)

    def listed(found):
        few = {w: k for w, k in found.items() if len(w) <= FREQUENT_BYTES and len(data := w.encode()) <= FREQUENT_BYTES and data not in ranks}
        return pa.RecordBatch.from_arrays([pa.array(few, pa.string()), pa.array(few.values(), pa.int64())], names=["word", "n"])

    def as_bytes(batches):
        tables = [_leading(x, 0) for x in rank_map.columns(ranks)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_WORDS):
                words = batch.column(0).slice(at, ROW_WORDS)
                data = _byte_lists([x.as_py().encode() for x in words])
                yield pa.RecordBatch.from_arrays([_leading(pa.array(words.to_pylist(), pa.string()), 0), _leading(data, 0), *tables], names=["word", "data", *TABLES])

    counted = staged(sample.mapInArrow(lean(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    least, room = 1, most
    for times, words in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        room -= words
        if room < 0:
            least = times + 1
            break
    give_back(texts.sparkSession)
    top = counted.filter(F.col("n") >= least).select("word").mapInArrow(lean(as_bytes), f"word array<string>, data array<array<int>>, {RankMap.KINDS}")
    folded = top.select("word", fold_merges(F.col("data"), rank_map.end).alias("ids"), "pieces")
    found = folded.select("word", id_texts(F.col("ids")).alias("ids"), decode_ids(F.col("ids"), F.col("pieces")).alias("decoded")).toArrow()
    return pa.table({c: pc.list_flatten(found.column(c)) for c in found.column_names})


def encode(docs: DataFrame, ranks: dict[bytes, int], *, pattern: str = PATTERN, with_ids: bool = False, max_frequent: int = MAX_FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (and ids with ``with_ids``).

    Every match of ``pattern`` is encoded by itself; a match that is a token
    is that token. ids_sha256 is the digest of the decimal ids joined by
    commas, decoded_sha256 that of the bytes that the ids decode to. Null and
    empty texts have no ids. Repeated rows and null ids are kept, other columns
    are ignored, an empty table gives an empty table. Memory is bounded by one
    dictionary of MAX_WORDS words and one Arrow batch; ``max_frequent`` words are
    held by the driver, fewer of them cost time and change no result. The
    session's plan texts are cut to PLAN_TEXT characters from then on.
    """
    if any(bytes([b]) not in ranks for b in range(256)) or max(ranks.values()) + 1 >= RankMap.SPAN:
        raise ValueError("all single bytes need a rank, and ranks are below 2 ** 17 - 1")
    kind = docs.schema[id_col].dataType.simpleString()

    spark = docs.sparkSession
    give_back(spark)  # what earlier work has left on the driver
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")) > PLAN_TEXT:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    rank_map = RankMap.of(ranks)
    frequent = _frequent(docs.select(text_col), ranks, rank_map, pattern, max_frequent)
    ahead = frequent.num_rows
    give_back(spark)

    def split(batches):
        words = frequent.column("word").to_pylist()
        known, tables = Numbers(words), rank_map.columns(ranks)
        restart, codes, own, room = False, [], [], ROW_CODES
        data: list[bytes] = []
        given: list[list[int]] = []
        size = 0

        def packed():
            head = bool(data or restart)
            row = [pa.array([restart] * head + [False] * len(own)), _byte_lists(data), _listed(given, pa.int32())]
            row[1:] = [_leading(x, len(own)).slice(not head) for x in row[1:]]
            full = [_leading(x if data else x.slice(0, 0), len(own)).slice(not head) for x in tables]
            return pa.RecordBatch.from_arrays([*row, pa.array([None] * head + codes, pa.binary()), pa.array([None] * head + own, id_type), pa.array([False] * head + [True] * len(own)), *full], names=["restart", "data", "given", "codes", id_col, "is_doc", *TABLES])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                if len(known) > ahead + MAX_WORDS:
                    yield packed()
                    known = Numbers(words)
                    restart, codes, own, data, given, room, size = True, [], [], [], [], ROW_CODES, 0
                text = value.as_py() or ""
                found = array("i", map(known.__getitem__, words_of(text, pattern))).tobytes()
                for word in known.fresh:
                    if len(data) >= ROW_WORDS or size >= ROW_BYTES:
                        yield packed()
                        restart, codes, own, data, given, room, size = False, [], [], [], [], ROW_CODES, 0
                    plain = word.encode()
                    direct = ranks.get(plain)
                    long = direct is None and len(plain) > FOLD_BYTES
                    given.append([direct] if direct is not None else merge_long(plain, ranks) if long else [])
                    data.append(b"" if given[-1] else plain)
                    size += len(plain)
                known.fresh = []
                codes.append(found)
                own.append(key.as_py())
                room -= len(found)
                if room < 0 or len(own) >= ROW_WORDS:
                    yield packed()
                    restart, codes, own, data, given, room, size = False, [], [], [], [], ROW_CODES, 0
            if own:
                yield packed()
                restart, codes, own, data, given, room, size = False, [], [], [], [], ROW_CODES, 0

    def join(batches):
        texts, pieces = (frequent.column(c).to_pylist() for c in ("ids", "decoded"))
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            words, joined_words, codes, restarts, is_doc = batch.column(1), batch.column(0), batch.column(2), batch.column(3).to_pylist(), batch.column(5).to_pylist()
            for k in range(batch.num_rows):
                if restarts[k]:
                    del texts[ahead:], pieces[ahead:]
                if not is_doc[k]:
                    texts += joined_words[k].as_py()
                    pieces += words[k].as_py()
                    continue
                places = np.frombuffer(codes[k].as_py(), np.int32).tolist()
                joined = b",".join(map(texts.__getitem__, places))
                out[0].append(batch.column(4)[k].as_py())
                out[1].append(joined.count(b",") + 1 if places else 0)
                out[2].append(hashlib.sha256(joined).hexdigest())
                out[3].append(hashlib.sha256(b"".join(map(pieces.__getitem__, places))).hexdigest())
                if with_ids:
                    out[4].append([int(x) for x in joined.split(b",")] if joined else [])
            types = (batch.schema.field(4).type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            n = 5 if with_ids else 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:n])

    rows = docs.select(id_col, text_col).mapInArrow(lean(split), f"restart boolean, data array<array<int>>, given array<array<int>>, codes binary, {id_col} {kind}, is_doc boolean, {RankMap.KINDS}")
    ids = F.zip_with(fold_merges(F.col("data"), rank_map.end), "given", lambda merged, given: F.when(F.size(given) > 0, given).otherwise(merged))
    rows = rows.select(ids.alias("ids"), "codes", "restart", id_col, "is_doc", "pieces")
    rows = rows.select(id_texts(F.col("ids")).alias("ids"), decode_ids(F.col("ids"), F.col("pieces")).alias("decoded"), "codes", "restart", id_col, "is_doc")
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lean(join), schema)
