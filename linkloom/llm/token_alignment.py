"""Alignment of two tokenizers over bitsets of token ends.

A marks the last byte of each of its tokens in one packed bitset, B in another.
Their AND has the cuts that both share; popcounts give ranks, which map a cut
to the token ranges left of it, and so the groups between cuts. Their OR cuts
the bytes into pieces that lie in one token of each side: every piece is one
link. Texts are taken in chunks that begin with white space, where both sides
end a token anyway, so each chunk is encoded once and then remembered.

How many documents hold a pair of linked ids is counted per block of documents
first, summed over blocks, and brought back to the block, whose documents then
look their links up.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged
from .token_output import _is_byte_level

#: Bytes of text that are aligned at once, and that make a block of documents.
ALIGN_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
#: Chunks in a worker's memory, and the longest that are remembered.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64
#: Characters of new chunks that are encoded in one call.
JOINED_CHARS = 1 << 15
#: Bits of an id within a pair of ids.
ID_BITS = 20

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than space and line feed, and the sign that B writes for a space: such texts are encoded whole.
_ODD = re.compile(r"[^\S \n]|▁")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on, in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoEncoders:
    """Ids of both sides: space + text by A (byte-level), text by B (pieces, which adds the space)."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        to_byte = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(to_byte.__getitem__, entry)) if all(c in to_byte for c in entry) else entry.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids have at most {ID_BITS} bits")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        #: Whether both sides end a token wherever white space follows anything else.
        own = [p.replace("▁", " ") for p, raw in pieces if not raw]
        self.apart = _is_byte_level(definition) and not any("\n" in p or " " in p.lstrip(" ") for p in own)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.old_a: dict[str, bytes] = {}
        self.old_b: dict[str, bytes] = {}
        self.broken: set[str] = set()

    def _kept(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text, None if the tokens' bytes are not those of space + text."""
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        return (np.array(a, np.int64), np.array(b, np.int64)) if self._kept(f" {text}".encode(), a, b) else None

    def learn(self, chunks: set[str]) -> None:
        """Encode what is new among ``chunks``, each of which begins with white space.

        When the young memory is full it becomes the old one, from which chunks
        in use move back. New chunks are encoded many at a time, one behind the
        other, since both sides end a token where the next one begins.
        """
        if len(self.known_a) > MEMO_ENTRIES:
            self.old_a, self.old_b, self.known_a, self.known_b = self.known_a, self.known_b, {}, {}
        fresh, size = [], 0
        for chunk in chunks:
            if chunk in self.known_a:
                continue
            if (was := self.old_a.get(chunk)) is not None:
                self.known_a[chunk], self.known_b[chunk] = was, self.old_b[chunk]
            elif chunk[-1] in " \n":
                # blank to its end: it would run into the next chunk's white space
                self._learned([chunk])
            else:
                fresh.append(chunk)
                size += len(chunk)
                if size >= JOINED_CHARS:
                    self._learned(fresh)
                    fresh, size = [], 0
        if fresh:
            self._learned(fresh)

    def _learned(self, chunks: list[str]) -> None:
        text = "".join(chunks)
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # B adds a space in front: it stands for the text's own one, or goes again
        b = [self.blank] if text == " " else self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        ends = np.cumsum([len(c.encode()) for c in chunks])
        if not self._kept(text.encode(), a, b):
            if len(chunks) == 1:
                self.broken.add(text)
                self.known_a[text] = self.known_b[text] = b""
            else:
                for chunk in chunks:
                    self._learned([chunk])
            return
        for ids, sizes, known in ((a, self.a_size, self.known_a), (b, self.b_size, self.known_b)):
            flat = np.array(ids, "<i4")
            places = (np.searchsorted(np.cumsum(sizes[flat]), ends) + 1) * 4
            raw, begin = flat.tobytes(), 0
            for chunk, end in zip(chunks, places.tolist(), strict=True):
                known[chunk] = raw[begin:end]
                begin = end

    def forget_long(self, chunks: set[str]) -> None:
        for chunk in chunks:
            if len(chunk) > MEMO_CHARS:
                self.known_a.pop(chunk, None)
                self.known_b.pop(chunk, None)
                self.broken.discard(chunk)

    def parts(self, text: str):
        """Lists of chunks of space + text, each of some ALIGN_BYTES, or None where the text is to be encoded whole."""
        if not self.apart or _ODD.search(text):
            yield None
            return
        found, part, size = _CHUNK.finditer(f" {text}"), [], 0
        if len(text) <= ALIGN_BYTES // 4:
            yield _CHUNK.findall(f" {text}")
            return
        while some := [m[0] for m in islice(found, ALIGN_BYTES // 16)]:
            part += some
            size += sum(map(len, some))
            if size >= ALIGN_BYTES // 4:
                yield part
                part, size = [], 0
        if part:
            yield part


@functools.lru_cache(maxsize=2)
def _encoders(definition: str, model: bytes) -> TwoEncoders:
    return TwoEncoders(definition, model)


class Bits:
    """A packed bitset with a directory of ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.size = int(counts.sum())

    @classmethod
    def marked(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of token sizes over the same bytes: (end of each group, A tokens and B tokens up to it; end of each link, its A token, its B token)."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    a, b = Bits.marked(ends_a - 1, total), Bits.marked(ends_b - 1, total)
    cuts, pieces = Bits(a.words & b.words).select(), Bits(a.words | b.words).select()
    return cuts + 1, a.rank(cuts) + 1, b.rank(cuts) + 1, pieces + 1, a.rank(pieces), b.rank(pieces)


class _Document:
    """What is known of a document while its parts are aligned."""

    __slots__ = ("counts", "digest", "pairs", "sound")

    def __init__(self):
        self.counts, self.digest, self.pairs, self.sound = np.zeros(4, np.int64), None, [], True

    def add(self, counts: list[int], groups: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        self.counts += counts
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(groups)
        self.pairs.append((pairs, times))

    def result(self) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links), digest, distinct pairs and how often each is linked."""
        if not self.sound or self.digest is None:
            return [0] * 4, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = self.pairs[0]
        if len(self.pairs) > 1:
            pairs, where = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            times = np.bincount(where, np.concatenate([t for _, t in self.pairs])).astype(np.int64)
        return self.counts.tolist(), self.digest.hexdigest(), pairs, times


@functools.lru_cache(maxsize=1)
def _numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with a comma, bar or semicolon behind it, as rows of bytes that end in zeros, and their lengths."""
    written = [f"{i}{mark}".encode() for i in range(size) for mark in ",|;"]
    table = np.array(written).view(np.uint8).reshape(len(written), -1)
    return table, (table != 0).sum(axis=1)


class Aligner:
    def __init__(self, encoders: TwoEncoders):
        self.encoders = encoders
        self.numerals, self.numeral_size = _numerals(max(len(encoders.a_bytes), len(encoders.b_bytes)))
        self.waiting: list[tuple[_Document, list[str] | None, str]] = []
        self.size = 0

    def take(self, text: str | None) -> _Document:
        document = _Document()
        if text:
            for part in self.encoders.parts(text):
                self.waiting.append((document, part, text if part is None else ""))
                self.size += len(text) if part is None else sum(map(len, part))
                if self.size >= ALIGN_BYTES:
                    self.flush()
        return document

    def flush(self) -> None:
        """Align all parts that wait."""
        encoders, todo, ids_a, ids_b = self.encoders, [], [], []
        every = set().union(*(part for _, part, _ in self.waiting if part is not None))
        encoders.learn(every)
        for document, part, text in self.waiting:
            if part is None:
                found = encoders.whole(text)
            elif encoders.broken and not encoders.broken.isdisjoint(part):
                found = None
            else:
                found = [np.frombuffer(b"".join(map(known.__getitem__, part)), "<i4").astype(np.int64) for known in (encoders.known_a, encoders.known_b)]
            if found is None:
                document.sound = False
            else:
                todo.append(document)
                ids_a.append(found[0])
                ids_b.append(found[1])
        encoders.forget_long(every)
        self.waiting, self.size = [], 0
        if todo:
            self._aligned(todo, ids_a, ids_b)

    def _aligned(self, todo: list[_Document], ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> None:
        n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        size_a = self.encoders.a_size[a]
        group_end, group_a, group_b, link_end, link_a, link_b = align(size_a, self.encoders.b_size[b])
        # parts end with a cut, so groups and links belong to one part
        part_end = np.concatenate([[0], np.cumsum(size_a)])[np.cumsum(n_a)]
        part_groups, part_links = np.searchsorted(group_end, part_end, "right"), np.searchsorted(link_end, part_end, "right")
        # every group writes its A tokens, then its B tokens
        in_a, in_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        code = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[group_a - 1], mark_b[group_b - 1] = 1, 2
        code[np.arange(len(a)) + np.repeat(group_b - in_b, in_a)] = a * 3 + mark_a
        code[np.arange(len(b)) + np.repeat(group_a, in_b)] = b * 3 + mark_b
        # distinct pairs of each part, with how often they are linked
        owner = np.repeat(np.arange(len(todo)), np.diff(part_links, prepend=0))
        keys, times = np.unique((owner << 2 * ID_BITS) | (a[link_a] << ID_BITS) | b[link_b], return_counts=True)
        part_keys = np.searchsorted(keys, np.arange(1, len(todo) + 1) << 2 * ID_BITS)
        keys &= (1 << 2 * ID_BITS) - 1
        written = self.numerals[code].ravel()
        written = written[written != 0].tobytes()
        part_written = np.cumsum(self.numeral_size[code])[np.cumsum(n_a + n_b) - 1]
        begin = [0, 0, 0, 0]
        for document, *ends in zip(todo, part_written.tolist(), part_groups.tolist(), part_links.tolist(), part_keys.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
            document.add([ends[4], ends[5], ends[1] - begin[1], ends[2] - begin[2]], written[begin[0] : ends[0] - 1], keys[begin[3] : ends[3]].copy(), times[begin[3] : ends[3]].copy())
            begin = ends[:4]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)).cast(kind))


def aligned(docs: DataFrame, definition: str, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, its block, and its distinct pairs as places in the block's list with how often.

    A block's list (pairs, ascending, and how many of its documents hold each) is on the block's first row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows_of(block: int, ids: list, documents: list[_Document]) -> pa.RecordBatch:
        results = [d.result() for d in documents]
        pairs = [r[2] for r in results]
        known, docs_with = np.unique(np.concatenate(pairs), return_counts=True)
        first = [0, *[len(known)] * len(ids)]
        lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int64())) for x in (known, docs_with)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, id_type),
                *(pa.array([r[0][i] for r in results], pa.int64()) for i in range(4)),
                pa.array([r[1] for r in results], pa.string()),
                pa.array([block] * len(ids), pa.int64()),
                _lists([np.searchsorted(known, p) for p in pairs], pa.int32()),
                _lists([r[3] for r in results], pa.int32()),
                *lists,
            ],
            names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "places", "times", "pairs", "n_docs"],
        )

    id_type = None

    def run(batches):
        nonlocal id_type
        aligner = Aligner(_encoders(definition, model))
        block, ids, documents, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                ids.append(id_)
                documents.append(aligner.take(text))
                size += len(text or "") + 100
                if size >= BLOCK_BYTES:
                    aligner.flush()
                    yield rows_of(block, ids, documents)
                    block, ids, documents, size = block + 1, [], [], 0
        aligner.flush()
        if ids:
            yield rows_of(block, ids, documents)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lean(run), f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block bigint, places array<int>, times array<int>, pairs array<bigint>, n_docs array<bigint>"
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best) of (block, pairs, n_docs): documents that hold the pair, and whether no pair of the same A id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).select("x.pairs", "x.n_docs")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("count"))
    of_a = F.shiftright("pair", ID_BITS).cast("int")
    # one row for each id of A's vocabulary at most
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_tokens(docs: DataFrame, definition: str, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``definition`` and ``model`` are the contents of A's and B's files. A text
    that is null or empty, or whose tokens' bytes are not those of space +
    text on both sides, has zeros and an empty digest. A pair's count is the
    number of rows that hold it, so repeated rows count each; null ids are
    kept; other columns are ignored; an empty table gives an empty table. Very long
    texts are aligned part by part. A block of documents, not one key, is what a
    task joins: its list has each pair once, however often documents hold it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = staged(aligned(docs, definition, model, id_col=id_col, text_col=text_col), "token-links")
    # read again, under columns of their own
    lists = docs.sparkSession.read.parquet(rows.staged_at).filter(F.size("pairs") > 0).select("block", "pairs", "n_docs")
    counts = staged(pair_counts(lists), "token-pairs")
    wanted = lists.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair").select("block", "place", "count", "best")

    def unit(ours: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        place = found.column("place").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy().astype(np.int64)
        ours = ours.combine_chunks()
        places, times = (ours.column(c).combine_chunks() for c in ("places", "times"))
        ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        at, often = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(often * x[at])]) for x in (best, count)]
        n_best, count_sum = (pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)
        kept = [ours.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*kept, n_best, count_sum, ours.column("groups_sha256")], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = rows.select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    return own.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(unit, f"{id_col} {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
