"""Search of links in a raw dump: a Bloom filter of the wanted ids passes over tuples before they are typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import ingest
from . import dump

#: Bits for each wanted id, and of a filter at most; more ids than that only let more tuples through.
BITS_EACH, MOST_BITS = 12, 1 << 20
HASHES = 4


class Bloom:
    """A filter of ids; ``may_hold`` is true for each of them and for few others."""

    def __init__(self, ids: DataFrame):
        own = ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).filter("id is not null")
        n = own.count()
        self.bits = 64
        while self.bits < min(n * BITS_EACH, MOST_BITS):
            self.bits *= 2
        places = own.select(F.explode(F.array(*(self._place(F.col("id"), k) for k in range(HASHES)))).alias("place"))
        words = places.groupBy(F.expr("place div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        self.words = [0] * (self.bits // 64)
        # at most MOST_BITS / 64 rows, whatever the number of ids
        for r in words.collect():
            self.words[r["word"]] = r["bits"]

    def _place(self, id_: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(id_, F.lit(k)), F.lit(self.bits).cast("bigint"))

    def may_hold(self, id_: Column) -> Column:
        # one literal: the optimizer folds the text into an array
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for k in range(HASHES):
            place = self._place(id_, k)
            found = found & (F.getbit(F.get(words, (place / 64).cast("int")), (place % 64).cast("int")) == 1)
        return F.coalesce(found, F.lit(False))


def links_of_pages(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, Observation]:
    """(pl_from, pl_from_namespace, pl_target_id) of the raw pagelinks statements whose source is among ``pages`` (ids), and a metric.

    The first number of each raw tuple is held against the filter; only what
    it lets through is typed, and then against the ids themselves. The metric has
    n_tuples and n_typed once an action has run.
    """
    raw = dump.raw_tuples(lines, "pagelinks").select("tuple", F.regexp_extract("tuple", r"^\(\s*(\d+)", 1).try_cast("bigint").alias("_first"))
    maybe = Bloom(pages).may_hold(F.col("_first"))
    metric = Observation()
    marked = raw.withColumn("_maybe", maybe).observe(metric, F.count("*").alias("n_tuples"), F.count_if("_maybe").alias("n_typed"))
    typed = dump.typed_tuples(marked.filter("_maybe").select("tuple"), schemas.DUMP["pagelinks"])
    ids = pages.select(F.col(pages.columns[0]).cast("bigint").alias("pl_from")).distinct()
    return typed.join(ids, "pl_from", "left_semi"), metric


def search_links(spark: SparkSession, pagelinks_path: str, linktarget_path: str, pages: DataFrame, *, to: str | None = None) -> DataFrame:
    """(page_id, lt_title): the links of ``pages`` (ids) as a dump has them, article to article; with ``to`` only links to that title.

    Equal links of a dump stay as often as they stand there. Titles of targets are not looked up among the pages.
    """
    found, _ = links_of_pages(dump.statements(spark, pagelinks_path, "pagelinks"), pages)
    targets = ingest.link_targets(dump.read_dump(spark, linktarget_path, "linktarget"))
    if to is not None:
        targets = targets.filter(F.col("lt_title") == to)
    own = found.filter("pl_from_namespace = 0")
    return own.join(targets, F.col("pl_target_id") == F.col("lt_id")).select(F.col("pl_from").alias("page_id"), "lt_title")
