"""An index of the link table: bucketed and sorted copies by either end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinkIndex:
    """Names of the two bucketed tables of a link table."""

    by_source: str
    by_target: str
    buckets: int

    def outgoing(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.by_source)

    def incoming(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.by_target)


def build(link: DataFrame, name: str, path: str, *, buckets: int = 64) -> LinkIndex:
    """Write the links (page_id, page_link) bucketed and sorted by source and by target below ``path``.

    A lookup of one end reads one bucket; joins and sums by an end need no
    exchange. A repeated build under one name replaces the tables.
    """
    index = LinkIndex(f"{name}_by_source", f"{name}_by_target", buckets)
    for key, table in (("page_id", index.by_source), ("page_link", index.by_target)):
        # one file a bucket: rows are dealt by the same hash that buckets use
        rows = link.select("page_id", "page_link").repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path.rstrip('/')}/{table}").saveAsTable(table)
    return index


def links_from(spark: SparkSession, index: LinkIndex, id_: int) -> DataFrame:
    """Targets (page_link) of a page, from one bucket."""
    return index.outgoing(spark).filter(F.col("page_id") == id_).select("page_link")


def degrees_of(spark: SparkSession, index: LinkIndex, ids: list[int]) -> DataFrame:
    """(page_id, num_links, times_linked) of listed pages, from their buckets only, without an exchange of links."""
    wanted = [int(i) for i in ids]
    out = index.outgoing(spark).filter(F.col("page_id").isin(wanted)).groupBy("page_id").agg(F.count("*").alias("num_links"))
    into = index.incoming(spark).filter(F.col("page_link").isin(wanted)).groupBy(F.col("page_link").alias("page_id")).agg(F.count("*").alias("times_linked"))
    both = out.join(into, "page_id", "full_outer")
    return both.select("page_id", F.coalesce("num_links", F.lit(0)).alias("num_links"), F.coalesce("times_linked", F.lit(0)).alias("times_linked"))


def neighbours(spark: SparkSession, index: LinkIndex, page: DataFrame, id_: int, *, limit: int = 5) -> DataFrame:
    """(linked_id, num_links, times_linked, page_title): the ``limit`` most linked pages that a page links to.

    The page's own links are one bucket; their degrees are sums within the
    buckets of the index, which keep their partitioning through the joins.
    """
    near = links_from(spark, index, id_).select(F.col("page_link").alias("linked_id"))
    out = index.outgoing(spark).groupBy(F.col("page_id").alias("linked_id")).agg(F.count("*").alias("num_links"))
    into = index.incoming(spark).groupBy(F.col("page_link").alias("linked_id")).agg(F.count("*").alias("times_linked"))
    ranked = near.join(into, "linked_id", "left").join(out, "linked_id", "left")
    ranked = ranked.select("linked_id", F.coalesce("num_links", F.lit(0)).alias("num_links"), F.coalesce("times_linked", F.lit(0)).alias("times_linked"))
    top = ranked.orderBy(F.desc("times_linked"), "linked_id").limit(limit)
    return top.join(page.select(F.col("page_id").alias("linked_id"), "page_title"), "linked_id", "left")


def hot_links(link: DataFrame, n: int | None, *, incoming: bool = False) -> DataFrame:
    """The links of the ``n`` pages with most outgoing links (ties to smaller ids), to be cached for many searches; all of them for None, none for 0.

    ``incoming`` gives the links into these pages instead.
    """
    if n is None:
        return link
    hot = link.groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_id").limit(n).select(F.col("page_id").alias("_hot"))
    return link.join(F.broadcast(hot) if n <= 100_000 else hot, F.col("page_link" if incoming else "page_id") == F.col("_hot"), "left_semi")


def links_of_keys(link: DataFrame, keys: DataFrame, *, incoming: bool = False) -> DataFrame:
    """(key, neighbours) of the pages among ``keys`` (ids) only: the adjacency of a subset."""
    key, value = ("page_link", "page_id") if incoming else ("page_id", "page_link")
    wanted = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    return link.join(wanted, F.col(key) == F.col("_key"), "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("neighbours"))
