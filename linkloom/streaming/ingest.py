"""Incremental work: every dump file once, and the latest state of every task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import ingest
from ..sources import dump


def ingest_pages(spark: SparkSession, inbox: str, store: str, checkpoint: str, *, wiki_name: str) -> StreamingQuery:
    """Appends the pages of new page dumps in ``inbox`` to ``store`` and ends.

    A rerun reads only files that came since; the checkpoint knows the others.
    Statements of other tables in a file are passed over.
    """
    parts = spark.readStream.schema("value string").option("lineSep", ";\n").text(inbox)
    rows = ingest.pages(dump.parse_tuples(dump.statements_of(parts, "page"), schemas.DUMP["page"], "page")).withColumn("wiki_name", F.lit(wiki_name))
    writer = rows.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint)
    return writer.partitionBy("wiki_name").trigger(availableNow=True).start()


def each_new(spark: SparkSession, inbox: str, schema: T.StructType, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``work(rows, batch)`` once for the Parquet files that are new in ``inbox``."""
    rows = spark.readStream.schema(schema).parquet(inbox)
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events per type and window of event time, for streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
