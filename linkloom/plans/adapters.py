"""Page and link tables derived from the driver's tables, as DataFrames and as SQL.

Default graph: parts are pages, two neighbouring returned lines of an order
are a link, and a link belongs to the wiki (brand) of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_brand").alias("wiki_name"), F.col("p_partkey").alias("page_id"), title.alias("page_title"), (F.col("p_size") % 10 == 0).alias("is_redirect"))


def bare_links(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    first = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("page_id"))
    second = lines.withColumnRenamed("l_partkey", "page_link")
    return first.join(second, ["l_orderkey", "l_linenumber"]).filter("page_id <> page_link").select("page_id", "page_link").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_brand").alias("wiki_name"), F.col("p_partkey").alias("page_id"))
    return bare_links(spark, d).join(brands, "page_id").select("wiki_name", "page_id", "page_link")


def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of five wikis, each of which numbers its pages for itself."""
    key = F.col("p_partkey")
    title = F.concat("p_name", F.lit(" #"), key.cast("string"))
    return table(spark, d, "part").select(F.concat(F.lit("w"), (key % 5).cast("string")).alias("wiki_name"), F.expr("p_partkey div 5").alias("page_id"), title.alias("page_title"), (F.col("p_size") % 10 == 0).alias("is_redirect"))


def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """Links within the wikis of ``wiki_pages``: a link belongs to the wiki of its source."""
    return bare_links(spark, d).select(F.concat(F.lit("w"), (F.col("page_id") % 5).cast("string")).alias("wiki_name"), F.expr("page_id div 5").alias("page_id"), F.expr("page_link div 5").alias("page_link")).distinct()


def orders_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges from orders to customers, in one id space."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


def start_page(link: DataFrame) -> int:
    """The page with most outgoing links."""
    row = link.groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_id").first()
    return row["page_id"] if row else 0


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """(wiki_name, stat, dump_date, value): orders by priority and year, some values unknown."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("wiki_name"), F.year("o_orderdate").alias("dump_date")).agg(F.count("*").alias("n"))
    return rows.select("wiki_name", F.lit("num_orders").alias("stat"), "dump_date", F.when((F.col("n") % 3) != 0, F.col("n")).alias("value"))


PAGE_SQL = "page AS (SELECT p_brand AS wiki_name, p_partkey AS page_id, p_name || ' #' || p_partkey AS page_title, p_size % 10 = 0 AS is_redirect FROM part)"
LINK_SQL = """bare AS (SELECT DISTINCT a.l_partkey AS page_id, b.l_partkey AS page_link FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey
  WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'),
link AS (SELECT wiki_name, page_id, page_link FROM bare JOIN page USING (page_id))"""
WIKI_SQL = """raw AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey
  WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'),
page AS (SELECT 'w' || (p_partkey % 5) AS wiki_name, p_partkey // 5 AS page_id, p_name || ' #' || p_partkey AS page_title, p_size % 10 = 0 AS is_redirect FROM part),
link AS (SELECT DISTINCT 'w' || (a % 5) AS wiki_name, a // 5 AS page_id, b // 5 AS page_link FROM raw)"""
START_SQL = "start AS (SELECT page_id FROM link GROUP BY page_id ORDER BY count(*) DESC, page_id LIMIT 1)"
SNAPSHOT_SQL = """snapshot AS (SELECT wiki_name, 'num_orders' AS stat, dump_date, CASE WHEN n % 3 <> 0 THEN n END AS value FROM (
  SELECT o_orderpriority AS wiki_name, year(o_orderdate)::INTEGER AS dump_date, count(*) AS n FROM orders GROUP BY ALL))"""


def with_graph(body: str, *more: str, recursive: bool = False) -> str:
    """SQL over page and link, with further common tables."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([PAGE_SQL, LINK_SQL, *more]) + "\n" + body


def with_wikis(body: str, *more: str) -> str:
    """SQL over page and link of several wikis that use the same ids, with further common tables."""
    return "WITH " + ",\n".join([WIKI_SQL, *more]) + "\n" + body
