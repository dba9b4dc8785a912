"""Snapshots over time: trends, series, matrices, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("wiki_name", "stat")


def trend(rows: DataFrame) -> DataFrame:
    """Rows (wiki_name, stat, dump_date, value) with the last known value before.

    change, percent (0 if the value before is 0) and direction are null where
    no value comes before.
    """
    order = Window.partitionBy(*KEYS).orderBy("dump_date")
    rows = rows.withColumn("before", F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    change = F.col("value") - F.col("before")
    percent = F.when(F.col("before") == 0, 0.0 * change).otherwise(F.try_divide(change, F.col("before")) * 100)
    direction = F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "no change")
    return rows.withColumn("change", change).withColumn("percent", percent).withColumn("direction", direction)


def until(rows: DataFrame, date) -> DataFrame:
    return rows.filter(F.col("dump_date") <= F.lit(date))


def neighbours_in_time(dates: DataFrame) -> DataFrame:
    """Every dump date with the one before and after."""
    order = Window.orderBy("dump_date")
    return dates.select("dump_date").distinct().select("dump_date", F.lag("dump_date").over(order).alias("previous"), F.lead("dump_date").over(order).alias("next"))


def matrix(rows: DataFrame, wikis: list[str]) -> DataFrame:
    """One row per stat and dump date, one column per wiki; unknown values stay null."""
    return rows.groupBy("stat", "dump_date").pivot("wiki_name", wikis).agg(F.first("value"))


def long_form(summary: DataFrame, date: str) -> DataFrame:
    """A summary as (dump_date, wiki_name, stat, value) rows."""
    stats = [c for c in summary.columns if c != "wiki_name"]
    return summary.unpivot("wiki_name", stats, "stat", "value").select(F.lit(date).alias("dump_date"), "wiki_name", "stat", "value")


def size_table(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local sizes with the published ones where known, smallest first, unknown ones before."""
    return local.join(web, "wiki_name", "left").orderBy(F.asc_nulls_first("web_bytes"), "wiki_name")


def wiki_sizes(files: DataFrame, tables: list[str]) -> DataFrame:
    return files.groupBy("wiki_name").agg(F.sum("bytes").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("table").isin(tables), F.col("bytes"))), F.lit(0)).alias("selected_bytes"))
