"""Other sources and sinks: tables, snapshots, graph files, listings, saved web pages."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a graph is written by the driver.
SMALL_GRAPH = 100_000


def write_store(rows: DataFrame, path: str, *, bloom: str | None = None) -> None:
    """Parquet partitioned by dump_date and wiki_name (those that exist), replacing whole partitions."""
    keys = [c for c in ("dump_date", "wiki_name") if c in rows.columns]
    writer = rows.write.mode("overwrite").partitionBy(*keys) if keys else rows.write.mode("overwrite")
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON stats documents, one file per dump date; a document that does not fit is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("dump_date", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{8})", 1))


def write_document(rows: DataFrame, path: str) -> None:
    """One text file with the one JSON document in column value, as ``read_snapshots`` reads it."""
    rows.select("value").coalesce(1).write.mode("overwrite").text(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(wiki_name, table, bytes) of dump files below ``path``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring_index(name, "-", 1).alias("wiki_name"), F.regexp_extract(name, r"\d{8}-(.+?)\.sql", 1).alias("table"), F.col("length").alias("bytes"))


def md5_mismatches(spark: SparkSession, path: str, sums: DataFrame) -> DataFrame:
    """Files whose MD5 differs from ``sums`` (lines ``digest  name`` in column value)."""
    listed = sums.select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.get("p", F.lit(0)).alias("expected"), F.get("p", F.lit(1)).alias("name"))
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"))
    return files.join(listed, "name").filter("md5 <> expected")


def wikis(spark: SparkSession, path: str) -> DataFrame:
    """All wikis of a store."""
    return spark.read.parquet(path).select("wiki_name").distinct()


def href_links(html: Column) -> Column:
    """All link targets of an HTML column."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def dump_files_listed(html: Column) -> Column:
    """Table names of the dump files that an index page links to."""
    return F.regexp_extract_all(html, F.lit(r"\d{8}-(.+?)\.sql"), F.lit(1))


def page_views(documents: DataFrame) -> DataFrame:
    """(article, views, rank) of top page-view documents in column value."""
    article = "struct<article:string,views:bigint,rank:int>"
    parsed = documents.select(F.from_json("value", f"items array<struct<articles:array<{article}>>>").alias("d"))
    return parsed.select(F.explode(F.get("d.items", F.lit(0))["articles"]).alias("a")).select("a.*")


def api_pages(responses: DataFrame) -> DataFrame:
    """(page_id, title) of saved query responses in column value, all continuation pages together."""
    shape = "query struct<pages:array<struct<pageid:bigint,title:string>>>"
    return responses.select(F.explode(F.from_json("value", shape)["query"]["pages"]).alias("p")).select(F.col("p.pageid").alias("page_id"), "p.title")


def communities_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id bigint, page string")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML file of a small graph: vertices (id, label), edges (src, dst), in order of their ids."""
    nodes = vertices.select("id", "label").orderBy("id").limit(SMALL_GRAPH + 1).collect()
    arcs = edges.select("src", "dst").orderBy("src", "dst").limit(SMALL_GRAPH + 1).collect()
    if max(len(nodes), len(arcs)) > SMALL_GRAPH:
        raise ValueError(f"GraphML is for graphs of at most {SMALL_GRAPH} vertices and edges")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.write('<key id="label" for="node" attr.name="label" attr.type="string"/>\n<graph edgedefault="directed">\n')
        for n in nodes:
            f.write(f'<node id={quoteattr(str(n["id"]))}><data key="label">{escape(n["label"] or "")}</data></node>\n')
        for e in arcs:
            f.write(f'<edge source={quoteattr(str(e["src"]))} target={quoteattr(str(e["dst"]))}/>\n')
        f.write("</graph>\n</graphml>\n")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, label), edges (src, dst)) of a GraphML file."""
    xml = spark.read.format("xml")
    nodes = xml.schema("_id string, data array<struct<_VALUE:string,_key:string>>").option("rowTag", "node").load(path)
    label = F.get(F.filter("data", lambda d: d["_key"] == "label"), F.lit(0))["_VALUE"]
    arcs = spark.read.format("xml").schema("_source string, _target string").option("rowTag", "edge").load(path)
    return nodes.select(F.col("_id").cast("bigint").alias("id"), label.alias("label")), arcs.select(F.col("_source").cast("bigint").alias("src"), F.col("_target").cast("bigint").alias("dst"))


def schema_json(schema: T.StructType) -> str:
    return json.dumps(json.loads(schema.json()), indent=2)
