"""SimHash fingerprints and the classes of documents they link.

Candidates come from deletion-variant signatures: a fingerprint is cut into so
few segments that one of them differs by at most one bit, every segment is
indexed once for each of its bits with that bit wiped out, and equal keys meet.
Distinct fingerprints are indexed, so exact copies cost one row. Small buckets
are verified pair by pair; buckets beyond PAIR_BUCKET are linked through the
fingerprints half-way between their members, of which each member has a fixed
number, so no bucket is ever expanded into all its pairs and no link is lost.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, staged

BITS = 64
#: Members up to which a bucket's pairs are verified one by one.
PAIR_BUCKET = 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Column that tells rows apart which repeat an id.
ROW_HASH = "_row_hash"


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit majority fingerprint of a text's word shingles (0: no word).

    A-Z are lower-cased and words are runs of anything but ASCII white space,
    which is what bytes.lower() and bytes.split() do to UTF-8.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False)), len(words) - shingle + 1
    digests = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        block = np.fromiter(islice(digests, BLOCK), "<u8", count=min(BLOCK, n - at))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(digests: np.ndarray) -> int:
    """The fingerprint of shingles given by their hashes, repeats included (0: none)."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), BLOCK):
        ones += np.unpackbits(digests[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) for every row; fp is the unsigned fingerprint's bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)), "<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def deletion_keys(fp: F.Column, max_bits: int) -> F.Column:
    """All one-wildcard segment keys of a fingerprint, BITS of them.

    floor(max_bits / 2) + 1 segments leave at most one differing bit to one of
    them. A key is the wiped bit's place and the segment without that bit.
    """
    segments = max_bits // 2 + 1
    edges = [BITS * k // segments for k in range(segments + 1)]
    keys = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = F.shiftrightunsigned(fp, low)
        for bit in range(low, high):
            kept = ((1 << (high - low)) - 1) ^ (1 << (bit - low))
            keys.append(F.struct(F.lit(bit).cast("tinyint").alias("bit"), part.bitwiseAND(F.lit(_signed(kept)).cast("bigint")).alias("rest")))
    return F.array(*keys)


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) with a < b between distinct fingerprints ``prints.fp``.

    Every link joins fingerprints that differ in at most ``max_bits`` bits, and
    any two such fingerprints are connected by links (a bucket of over
    PAIR_BUCKET members is linked by stars instead of pairs; needs an even
    ``max_bits``, for odd ones all buckets are verified in pairs).
    """
    keyed = prints.select("fp", F.explode(deletion_keys(F.col("fp"), max_bits)).alias("key")).select("fp", "key.bit", "key.rest")
    members = keyed.withColumn("n", F.count("*").over(Window.partitionBy("bit", "rest"))).filter("n > 1")
    members = staged(members, "simhash-buckets")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    small = members.filter(F.col("n") <= PAIR_BUCKET) if max_bits % 2 == 0 else members
    left, right = small.select(F.col("fp").alias("a"), "bit", "rest"), small.select(F.col("fp").alias("b"), "bit", "rest")
    pairs = left.join(right, ["bit", "rest"]).filter((F.col("a") < F.col("b")) & (apart <= max_bits)).select("a", "b")
    if max_bits % 2 == 0:
        # fingerprints within max_bits of each other are both within half of that of one in the middle, and the other way round
        crowded = members.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
        around = crowded.select("fp", F.col("fp").alias("middle"))
        flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << bit)).cast("bigint") for bit in range(BITS)))
        for _ in range(max_bits // 2):
            around = around.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("middle")))).alias("middle"))
        hubs = around.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("others"))
        stars = hubs.filter(F.size("others") > 1).select("a", F.explode("others").alias("b")).filter("a != b")
        pairs = pairs.union(stars)
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b): the least node reachable.

    Alternating large and small stars: each round links every node to the least
    node around it, until every edge leads to a root. Minima are aggregated
    before they are joined back, so hubs gather no list, and every round is
    cut by a checkpoint in the shared folder.
    """

    def lowest(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias(name))

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(lowest(both, "m"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(lowest(large, "m"), "u")
        near = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(near.filter("a != b").distinct())
        if (fresh := state(now)) == seen:
            break
        seen = fresh
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the least id reachable over links, the row's own included.
    Null and word-less texts have fingerprint 0 and link like any other;
    repeated rows are returned as often as they come; a row with a null id
    links others but names no class (component_id is null in a class without
    any id); other columns are ignored; an empty table gives an empty table.
    """
    rows = staged(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "simhash-rows")
    prints = staged(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-prints")
    linked = components(links(prints.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    classes = prints.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _comparable(docs: DataFrame) -> list[F.Column]:
    """All columns of ``docs``, those that hold maps as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]


def row_hash(docs: DataFrame) -> F.Column:
    """A hash of all columns and of which of them are null."""
    nulls = F.concat(*(F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns))
    return F.xxhash64(nulls, *_comparable(docs))


def survivors(docs: DataFrame, rows: DataFrame, linked: DataFrame, *, id_col: str) -> DataFrame:
    """Of each class exactly one row of ``docs``: the least by id (nulls last), then by all other columns.

    ``rows`` has id, ROW_HASH and node of every row, ``linked`` the root of
    linked nodes. Rows are told apart by id and ROW_HASH, so rows that repeat
    an id, or have none, are decided by their own texts. Whole rows are
    compared only in classes where several have the least id.
    """
    roots = linked.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    found = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(ROW_HASH).alias("_hash"), F.col("node").alias("_node")).groupBy("_id", "_hash", "_node").agg(F.count("*").alias("_rows"))
    found = found.join(roots, "_node", "left").select("_id", "_hash", "_rows", F.coalesce("_root", "_node").alias("_root"))
    found = staged(found, "survivor-rows")
    least = found.groupBy("_root").agg(F.min("_id").alias("_least"))
    first = found.join(least, "_root").filter(F.col("_id").eqNullSafe(F.col("_least"))).select("_id", "_hash", "_root", "_rows")
    alone = first.groupBy("_root").agg(F.sum("_rows").alias("_rows")).select("_root", (F.col("_rows") == 1).alias("_alone"))
    first = staged(first.drop("_rows").join(alone, "_root"), "survivor-names")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.col(f"`{id_col}`").alias("_own"), row_hash(docs).alias(ROW_HASH), F.struct(*columns).alias("_row"), F.struct(*(c.alias(f"c{i}") for i, c in enumerate(_comparable(docs)))).alias("_order"))
    same = lambda named: (marked[ROW_HASH] == named["_hash"]) & marked["_own"].eqNullSafe(named["_id"])
    whole = lambda rows: rows.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    single, tied = first.filter("_alone"), first.filter("not _alone")
    kept = whole(marked.drop("_order").join(single, same(single), "left_semi"))
    if tied.isEmpty():
        return kept
    one = marked.join(tied, same(tied)).groupBy("_root").agg(F.min_by("_row", "_order").alias("_row"))
    return kept.union(whole(one))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate class, as ``survivors`` chooses it.

    Null and word-less texts are one class, rows with null or repeated ids are
    decided row by row, and an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)), "<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view("<i8"))], names=[id_col, ROW_HASH, "node"])

    rows = docs.select(F.col(f"`{id_col}`"), row_hash(docs).alias(ROW_HASH), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {ROW_HASH} bigint, node bigint")
    rows = staged(rows, "simhash-rows")
    linked = components(links(rows.select(F.col("node").alias("fp")).distinct(), max_bits))
    return survivors(docs, rows, linked, id_col=id_col)
