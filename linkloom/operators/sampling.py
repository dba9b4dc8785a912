"""Statistics of breadth-first samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_pages(page: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k pages in an order set by the seed (one digest per page, top k)."""
    return page.select("page_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_id").cast("string")).cast("binary")), "page_id").limit(k)


def average_histogram(hist: DataFrame, num_pages: int) -> DataFrame:
    """Per depth: mean and sample deviation of n / num_pages over the samples that have the depth."""
    share = F.col("n") / F.lit(float(num_pages))
    return hist.groupBy("depth").agg(F.avg(share).alias("mean"), F.coalesce(F.stddev_samp(share), F.lit(0.0)).alias("std_dev"))


def sweep(hist: DataFrame, order: DataFrame, sizes: list[int], num_pages: int) -> DataFrame:
    """(size, depth, mean, n_samples): the average histogram of nested samples, all sizes in one pass.

    ``order`` (source_id, place) puts the sources of ``hist`` in a seeded
    order; the sample of a size is its first sources. Sums run along the order
    once per depth and are read off at each size. A depth that no source of a
    sample reaches has no row; a size beyond the sources means all of them.
    """
    along = Window.partitionBy("depth").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(order, "source_id").select("depth", "place", F.sum(F.col("n") / F.lit(float(num_pages))).over(along).alias("total"), F.count("*").over(along).alias("n_samples"))
    last = [F.max_by(F.struct(F.lit(int(s)).alias("size"), "total", "n_samples"), F.when(F.col("place") <= s, F.col("place"))).alias(f"_{i}") for i, s in enumerate(sizes)]
    per = rows.groupBy("depth").agg(*last)
    each = per.select("depth", F.explode(F.array(*(F.col(f"_{i}") for i in range(len(sizes))))).alias("x")).filter("x is not null")
    return each.select("x.size", "depth", (F.col("x.total") / F.col("x.n_samples")).alias("mean"), "x.n_samples")


def cumulative(average: DataFrame) -> DataFrame:
    return average.withColumn("cdf", F.sum("mean").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))


def depth_for(cdf: DataFrame, share: float) -> DataFrame:
    """The first depth whose cumulative share is at least ``share``; no row if none is."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    return cdf.filter(F.col("cdf") >= share).orderBy("depth").limit(1).select("depth")


def max_min_avg(values: DataFrame) -> DataFrame:
    """Of rows (place, key, value): extremes with the first key, the mean, and avg_ref.

    avg_ref is the running (a + v) / 2 in order of place, as its closed form:
    the last value weighs 1/2, the one before 1/4, the first as much as the second.
    """
    order = Window.orderBy("place")
    back = F.count("*").over(Window.partitionBy()) - F.row_number().over(order)
    rows = values.withColumn("back", back).withColumn("first", F.row_number().over(order) == 1)
    weight = F.pow(F.lit(0.5), F.col("back") + F.when(F.col("first"), 0).otherwise(1))
    return rows.agg(
        F.min_by("key", F.struct("value", "place")).alias("min_key"), F.min("value").alias("min_value"),
        F.min_by("key", F.struct(-F.col("value"), F.col("place"))).alias("max_key"), F.max("value").alias("max_value"),
        F.avg("value").alias("avg"), F.sum(F.col("value") * weight).alias("avg_ref"),
    )


def path_lengths(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (source_id, target_id) with n_edges and n_nodes; 0 nodes if unreached, equal pairs skipped."""
    ends = reached.select("source_id", F.col("page_id").alias("target_id"), F.col("depth").alias("n_edges"))
    rows = pairs.filter("source_id <> target_id").join(ends, ["source_id", "target_id"], "left")
    return rows.withColumn("n_nodes", F.coalesce(F.col("n_edges") + 1, F.lit(0)))
