"""Incremental statistics: a table with one partition per dump date and wiki, brought up to date by new pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..operators.tables import cut
from . import ingest

COUNTS = ("num_pages", "num_redirects", "num_links", "num_linked_redirects", "num_dead", "num_orphan", "num_dead_orphan")
STATS = T.StructType([T.StructField("dump_date", T.StringType()), T.StructField("wiki_name", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS).parquet(path).select(*STATS.fieldNames())


def _upsert(rows: DataFrame, path: str) -> None:
    """Replace the partitions of ``rows``; the others stay."""
    rows.select(*STATS.fieldNames()).repartition("dump_date", "wiki_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dump_date", "wiki_name").parquet(path)


def refresh(page: DataFrame, link: DataFrame, path: str, changed: DataFrame) -> None:
    """Recompute the counts of the ``changed`` wikis (dump_date, wiki_name) from the stores, and the totals of their dump dates.

    Only the partitions of changed wikis are read from the stores; totals are
    sums over the table itself. What is written depends on the stores alone,
    so a batch that comes again after a failure writes the same.
    """
    spark, keys = page.sparkSession, ["dump_date", "wiki_name"]
    changed = cut(changed.select(*(F.col(k).cast("string") for k in keys)).distinct())
    own, theirs = (rows.withColumn("dump_date", F.col("dump_date").cast("string")).join(changed, keys, "left_semi") for rows in (page, link))
    _upsert(stats.summary(own, theirs).filter(F.col("wiki_name") != stats.GLOBAL), path)
    dates = changed.select("dump_date").distinct()
    wikis = read_table(spark, path).filter(F.col("wiki_name") != stats.GLOBAL).withColumn("dump_date", F.col("dump_date").cast("string")).join(dates, "dump_date", "left_semi")
    totals = wikis.groupBy("dump_date").agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumn("wiki_name", F.lit(stats.GLOBAL))
    # the table is read and written, so the totals are computed before
    _upsert(cut(totals), path)


def follow_links(spark: SparkSession, page_store: str, link_store: str, link_schema: T.StructType, path: str, checkpoint: str) -> StreamingQuery:
    """Brings the table up to date with the link files that are new in the store, and ends.

    The checkpoint knows which files were seen; a rerun without new files
    starts no batch, and one with links of a new wiki changes that wiki's rows and the totals.
    """

    def work(batch: DataFrame, _: int) -> None:
        changed = batch.select("dump_date", "wiki_name").distinct()
        refresh(spark.read.parquet(page_store), spark.read.parquet(link_store), path, changed)

    return ingest.each_new(spark, link_store, link_schema, checkpoint, work)
