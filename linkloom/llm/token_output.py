"""Token ids as Parquet list columns, for selective reads.

A store holds documents in ascending id order, one file per shard. Row groups,
pages and the encoding of the id column are set by the writer, so that a reader
can take documents by id range (row-group statistics and page indexes) or
metadata alone (column pruning) without touching other token pages.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LATIN_WORDS

#: Words in one generation of a Python worker's memory.
MEMO_ENTRIES = 400_000
#: Longer texts are split piece by piece instead of all at once.
LONG = 1 << 20

PLAIN = re.compile("[^\\x00-\\xff]")
SPLIT = re.compile(LATIN_WORDS)

#: Whether this machine's own arrays are not little-endian unsigned 32-bit integers.
SWAPPED = sys.byteorder != "little" or array("I").itemsize != 4


def _byte_names() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: themselves where they print, else the next ones from U+0100 on."""
    prints, spare = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}, count(0x100)
    return {b: chr(b if b in prints else next(spare)) for b in range(256)}


BYTE_NAMES = _byte_names()


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    Words of plain texts are encoded once and remembered; texts with other
    characters or with the string of a special token go to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: Iterable[str]) -> None:
        """Remember ``words``, which are not among the young; the library's model encodes those that are not among the old either."""
        if len(self.young) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        young, old, tokenize = self.young, self.old, self.library.model.tokenize
        for word in words:
            known = old.get(word)
            if known is None:
                # a word is one match of the splitting pattern, so all that is left to do before the model is to name its bytes
                ids = [x.id for x in tokenize(word.encode().decode("latin-1").translate(BYTE_NAMES))]
                known = struct.pack(f"<{len(ids)}I", *ids) if SWAPPED else array("I", ids).tobytes()
            young[word] = known

    def _join(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of texts given as their words; every word is looked up once, unless it is new."""
        found = [list(map(self.young.get, words)) for words in lists]
        gaps = [[i for i, ids in enumerate(one) if ids is None] for one in found]
        fresh = dict.fromkeys(words[i] for words, places in zip(lists, gaps, strict=True) for i in places)
        self._learn(fresh)
        for words, one, places in zip(lists, found, gaps, strict=True):
            for i in places:
                one[i] = self.young[words[i]]
        return list(map(b"".join, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if PLAIN.search(text) or any(s in text for s in self.special):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif len(text) <= LONG:
                plain.append(i)
            else:
                found, parts = (m[0] for m in SPLIT.finditer(text)), []
                while block := list(islice(found, LONG // 8)):
                    parts += self._join([block])
                out[i] = b"".join(parts)
        for i, ids in zip(plain, self._join([SPLIT.findall(texts[i]) for i in plain]), strict=True):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def _encoder(definition: str) -> WordEncoder:
    return WordEncoder(definition)


def small_batches(batch: pa.RecordBatch, rows: int = 512, size: int = 4 << 20):
    """Slices of a batch of (id, text) with at most ``rows`` rows and about ``size`` bytes of text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
    begin = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and (i - begin >= rows or total + n > size):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _is_byte_level(definition: str) -> bool:
    import json

    kind = json.loads(definition)
    split = kind.get("pre_tokenizer") or {}
    return kind.get("normalizer") is None and kind.get("post_processor") is None and kind["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


def write_tokens(
    docs: DataFrame,
    path: str,
    definition: str,
    *,
    end_id: int,
    shards: int | None = None,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every row of ``docs`` and write a token store at ``path``.

    Columns: id, shard, local_start (ids of the shard before the document),
    n_tokens and tokens, whose last id is ``end_id``. Documents ascend by id
    (null first, repeated ids by text) over and within the shards' files.
    ``encoding`` of the ids is "dictionary" or "delta" (binary-packed deltas).
    Null and empty texts give the end id alone; other columns are ignored.
    Only texts are shuffled, by ranges of the id; ids go straight to the files.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    if not _is_byte_level(definition):
        raise ValueError("only byte-level BPE definitions without normalizer or prefix space are supported")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "shard", "local_start", "n_tokens", "tokens"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, start, shard = _encoder(definition), 0, TaskContext.get().partitionId()
        for whole in batches:
            for batch in small_batches(whole):
                found = [ids + end for ids in encoder.encode([x or "" for x in batch.column(1).to_pylist()])]
                counts = np.fromiter((len(x) // 4 for x in found), np.int64, count=len(found))
                offsets = np.concatenate([[0], np.cumsum(counts)])
                ids = np.frombuffer(b"".join(found), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(found), shard, np.int32)), pa.array(offsets[:-1] + start), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=names,
                )
                start += int(offsets[-1])

    rows = docs.select(id_col, text_col)
    rows = rows.repartitionByRange(shards, id_col) if shards else rows.repartitionByRange(id_col)
    rows = rows.sortWithinPartitions(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, shard int, local_start bigint, n_tokens bigint, tokens array<int>")
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": 4 << 20,
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
        "compression": "zstd",
    }
    rows.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """A store's rows: ``where`` reaches the files' statistics, ``columns`` prunes."""
    rows = spark.read.parquet(path)
    rows = rows.filter(where) if where is not None else rows
    return rows.select(*columns) if columns else rows


def token_index(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per stored document: id, start, n_tokens, ids_crc32, read from the files.

    start counts the ids of all documents before it; ids_crc32 is the CRC-32 of
    its ids as little-endian unsigned 32-bit integers. Totals are summed per
    shard, one row each, before they are added up in order.
    """
    stored = read_tokens(spark, path)
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets, ids = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=[id_col, "shard", "local_start", "n_tokens", "ids_crc32"])

    read = stored.select(id_col, "shard", "local_start", "tokens").mapInArrow(run, f"{id_col} {kind}, shard int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return read.join(bases, "shard").select(id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
