"""Precomputed traversal trees: a store partitioned by source, and a statistic of each tree.

A source's tree is one partition of the store. Runs replace whole partitions
and skip sources that are there, so a run that was broken off is finished by
the next one and a repeated run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BFS_TREE, TREE_STAT
from . import graph
from .tables import cut


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def _replace(rows: DataFrame, path: str, *keys: str) -> None:
    """Write the partitions of ``rows``; those of other keys stay as they are."""
    rows.repartition(*keys).sortWithinPartitions(*keys, "page_id" if "page_id" in rows.columns else keys[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_trees(spark: SparkSession, store: str) -> DataFrame:
    """(source_id, page_id, depth, previous_id) of all stored trees; no row where nothing is stored."""
    return _stored(spark, store, BFS_TREE)


def computed(spark: SparkSession, store: str) -> DataFrame:
    """(source_id) of the sources whose trees are stored; a tree has its source as a row, so the shallow rows suffice."""
    return read_trees(spark, store).filter("depth = 0").select("source_id").distinct()


def precompute(edges: DataFrame, sources: list[int], store: str) -> list[int]:
    """Add the trees of those ``sources`` that the store lacks, all in one search; the sources that were added."""
    spark = edges.sparkSession
    known = {r[0] for r in computed(spark, store).filter(F.col("source_id").isin([int(s) for s in sources])).collect()}
    fresh = [int(s) for s in dict.fromkeys(sources) if int(s) not in known]
    if fresh:
        _replace(graph.bfs(edges, fresh), store, "source_id")
    return fresh


def stored_path(spark: SparkSession, store: str, source: int, target: int) -> list[int]:
    """The path from a stored source to ``target``; only the source's partition is read. An unreached target is alone on it."""
    return graph.path_to(read_trees(spark, store), source, target)


def longest_paths(trees: DataFrame) -> DataFrame:
    """(source_id, path): the ids from each source to its deepest node (the smallest of equals), all sources side by side."""
    trees = trees.select("source_id", "page_id", "depth", "previous_id")
    deepest = trees.groupBy("source_id").agg(F.min_by(F.struct("page_id", "depth"), F.struct(-F.col("depth"), "page_id")).alias("end"))
    walks = cut(deepest.select("source_id", F.array("end.page_id").alias("path"), "end.depth"))
    most = walks.agg(F.max("depth")).first()[0] or 0
    # one folder a depth: a step reads only the nodes at its own
    steps = cut(trees.select(F.col("source_id").alias("_source"), F.col("page_id").alias("_page"), "previous_id", F.col("depth").alias("_depth")), parts="_depth")
    for depth in range(most, 0, -1):
        at = F.col("depth") == depth
        up = walks.filter(at).join(steps.filter(F.col("_depth") == depth), (F.col("source_id") == F.col("_source")) & (F.get("path", F.lit(0)) == F.col("_page")))
        higher = up.select("source_id", F.concat(F.array("previous_id"), "path").alias("path"), F.lit(depth - 1).alias("depth"))
        walks = cut(walks.filter(~at).union(higher))
    return walks.select("source_id", "path")


def tree_stats(trees: DataFrame, page: DataFrame) -> DataFrame:
    """(wiki_name, source_id, page_title, longest_path, num_visited, depth_histogram) of each tree.

    longest_path has the titles behind the source, depth_histogram the nodes
    first reached at each depth, as a map. ``page`` has wiki_name, page_id and
    page_title; a page without title has a null there.
    """
    counted = trees.filter("depth > 0").groupBy("source_id", "depth").agg(F.count("*").alias("n"))
    per = counted.groupBy("source_id").agg(F.sum("n").alias("num_visited"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("depth", "n")))).alias("depth_histogram"))
    titles = page.select("page_id", "page_title")
    paths = longest_paths(trees)
    steps = paths.select("source_id", F.posexplode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).alias("place", "page_id")).join(titles, "page_id", "left")
    named = steps.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_title"))), lambda x: x["page_title"]).alias("longest_path"))
    sources = trees.filter("depth = 0").select("source_id").join(page.select("wiki_name", F.col("page_id").alias("source_id"), "page_title"), "source_id", "left")
    found = sources.join(per, "source_id", "left").join(named, "source_id", "left")
    none = F.create_map().cast("map<int,bigint>")
    return found.select("wiki_name", "source_id", "page_title", F.coalesce("longest_path", F.array().cast("array<string>")).alias("longest_path"), F.coalesce("num_visited", F.lit(0)).cast("bigint").alias("num_visited"), F.coalesce("depth_histogram", none).alias("depth_histogram"))


def upsert_stats(stats: DataFrame, path: str) -> None:
    """Store statistics, one partition per wiki and source: those of other sources stay, a repeated one is replaced."""
    _replace(stats, path, "wiki_name", "source_id")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, TREE_STAT)


def stats_json(stats: DataFrame) -> DataFrame:
    """One row (value): the nested document wiki, title, {longest_path, num_visited, depth_histogram} as JSON.

    Of pages of a wiki that share a title the least source counts.
    """
    one = stats.groupBy("wiki_name", "page_title").agg(F.min_by(F.struct("longest_path", "num_visited", "depth_histogram"), "source_id").alias("stat"))
    texts = one.select("wiki_name", "page_title", F.to_json("stat").alias("stat"))
    # maps of maps cannot be ordered, so inner documents are put together as text
    inner = texts.groupBy("wiki_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat(_quoted("page_title"), F.lit(":"), "stat"))), ",").alias("all"))
    outer = inner.agg(F.array_join(F.array_sort(F.collect_list(F.concat(_quoted("wiki_name"), F.lit(":{"), "all", F.lit("}")))), ",").alias("all"))
    return outer.select(F.concat(F.lit("{"), "all", F.lit("}")).alias("value"))


def _quoted(name: str) -> Column:
    """A string as JSON; null as the word."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1), F.lit('"null"'))
