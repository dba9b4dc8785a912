"""Stored trees, the link index, search in raw dumps, sweeps, and the dump reader's odd files."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import graph, sampling, tables, trees
from linkloom.sources import dump, index, search
from linkloom.streaming import ingest as streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (2, 5), (6, 7)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src bigint, dst bigint")


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([("w", i, t) for i, t in enumerate("ABCDEFGH", 1)], "wiki_name string, page_id bigint, page_title string")


def test_tree_store_computes_only_what_is_missing(spark, edges, page, tmp_path):
    store = str(tmp_path / "trees")
    assert trees.computed(spark, store).count() == 0 and trees.read_trees(spark, store).count() == 0
    assert trees.precompute(edges, [1, 8], store) == [1, 8]
    before = {f: os.path.getmtime(f"{store}/source_id=1/{f}") for f in os.listdir(f"{store}/source_id=1")}
    assert trees.precompute(edges, [4, 1, 4, 8], store) == [4] and trees.precompute(edges, [1, 4, 8], store) == []
    assert {f: os.path.getmtime(f"{store}/source_id=1/{f}") for f in os.listdir(f"{store}/source_id=1")} == before
    assert rows(trees.computed(spark, store)) == [(1,), (4,), (8,)]
    assert rows(trees.read_trees(spark, store)) == rows(graph.bfs(edges, [1, 4, 8]).select("source_id", "page_id", "depth", "previous_id"))
    assert trees.stored_path(spark, store, 4, 5) == [4, 1, 2, 5] and trees.stored_path(spark, store, 8, 1) == [1]
    plan = trees.read_trees(spark, store).filter("source_id = 4")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan
    stats = trees.tree_stats(trees.read_trees(spark, store), page)
    path = str(tmp_path / "stats")
    trees.upsert_stats(stats, path)
    trees.upsert_stats(stats.filter("source_id = 4"), path)
    found = {r["source_id"]: r for r in trees.read_stats(spark, path).collect()}
    assert len(found) == 3 and found[4]["longest_path"] == ["A", "B", "E"] and found[4]["depth_histogram"] == {1: 1, 2: 2, 3: 1} and found[4]["num_visited"] == 4
    assert (found[8]["longest_path"], found[8]["num_visited"], found[8]["depth_histogram"]) == ([], 0, {})
    document = json.loads(trees.stats_json(trees.read_stats(spark, path)).first()[0])
    assert set(document["w"]) == {"A", "D", "H"} and document["w"]["D"]["longest_path"] == ["A", "B", "E"] and document["w"]["D"]["depth_histogram"] == {"1": 1, "2": 2, "3": 1}


def test_index_reads_single_buckets(spark, tmp_path):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(2000)})
    link = spark.createDataFrame(pairs, "page_id bigint, page_link bigint")
    found = index.build(link, "test_links", str(tmp_path), buckets=8)
    again = index.build(link, "test_links", str(tmp_path), buckets=8)
    assert found == again
    near = index.links_from(spark, found, 7)
    assert rows(near) == sorted(((b,) for a, b in pairs if a == 7), key=repr)
    # the plan only names the buckets where scans keep to them
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in index.links_from(spark, found, 7)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    ids = [b for a, b in pairs if a == 7] + [9999]
    degrees = index.degrees_of(spark, found, ids)
    count = lambda k, i: sum(p[k] == i for p in pairs)
    assert rows(degrees) == sorted(((i, count(0, i), count(1, i)) for i in ids[:-1]), key=repr)
    assert "Exchange hashpartitioning" not in degrees._jdf.queryExecution().executedPlan().toString()
    page = spark.createDataFrame([(i, f"T{i}") for i in range(200)], "page_id bigint, page_title string")
    top = index.neighbours(spark, found, page, 7, limit=3)
    best = sorted(ids[:-1], key=lambda i: (-count(1, i), i))[:3]
    assert rows(top) == sorted(((i, count(0, i), count(1, i), f"T{i}") for i in best), key=repr)
    assert index.hot_links(link, None).count() == len(pairs) and index.hot_links(link, 0).count() == 0
    hottest = min(range(200), key=lambda i: (-count(0, i), i))
    assert {r[0] for r in index.hot_links(link, 1).collect()} == {hottest} and {r[1] for r in index.hot_links(link, 1, incoming=True).collect()} <= {hottest}


def test_search_types_only_what_may_match(spark, tmp_path):
    tuples = [f"({i},{i % 2},{i * 10})" for i in range(5000)]
    lines = [f"INSERT INTO `pagelinks` VALUES {','.join(tuples[k : k + 100])}" for k in range(0, 5000, 100)]
    wanted = spark.createDataFrame([(4,), (17,), (4998,), (None,), (100_000,)], "id bigint")
    found, metric = search.links_of_pages(spark.createDataFrame([(x,) for x in [*lines, "INSERT INTO `linktarget` VALUES (4,0,'x')"]], "value string"), wanted)
    assert rows(found) == [(17, 1, 170), (4, 0, 40), (4998, 0, 49980)]
    assert metric.get["n_tuples"] == 5000 and 3 <= metric.get["n_typed"] < 100
    assert search.links_of_pages(spark.createDataFrame([(x,) for x in lines], "value string"), wanted.limit(0))[0].count() == 0
    (tmp_path / "p.sql").write_text(";\n".join(lines) + ";\n")
    (tmp_path / "t.sql").write_text("INSERT INTO `linktarget` VALUES (40,0,'Forty'),(170,0,'Odd'),(49980,1,'Talk'),(49980,0,'Last');\n")
    paths = str(tmp_path / "p.sql"), str(tmp_path / "t.sql")
    assert rows(search.search_links(spark, *paths, wanted)) == [(4, "Forty"), (4998, "Last")]
    assert rows(search.search_links(spark, *paths, wanted, to="Last")) == [(4998, "Last")]


def test_sweep_equals_separate_runs(spark, edges):
    starts = [4, 1, 6, 8, 2]
    order = spark.createDataFrame([(s, i + 1) for i, s in enumerate(starts)], "source_id bigint, place int")
    found = sampling.sweep(graph.histograms(edges, starts), order, [1, 2, 4, 100], 8).collect()
    for size in (1, 2, 4, 100):
        separate = sampling.average_histogram(graph.histograms(edges, starts[:size]), 8).collect()
        assert {(r["depth"], round(r["mean"], 9)) for r in found if r["size"] == size} == {(r["depth"], round(r["mean"], 9)) for r in separate}


INSERT = "INSERT INTO `linktarget` VALUES (1,0,'A -- b'),(2,0,'/* no comment */')"


@pytest.mark.parametrize("before", ["", "/* two\nlines */\n", "-- a\n" * 3000, "\n\n/* one */ -- two\n/*!40000 SET x */\n", "SET a = 1;\n", "-- INSERT INTO nothing\n"])
def test_comments_before_an_insert(spark, tmp_path, before):
    (tmp_path / "d.sql").write_text(f"{before}{INSERT};\n{before}INSERT INTO `page` VALUES (9);\n")
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write(f"{before}{INSERT};\r\n")
    for name in ("d.sql", "d.sql.gz"):
        assert rows(dump.read_dump(spark, str(tmp_path / name), "linktarget")) == [(1, 0, "A -- b"), (2, 0, "/* no comment */")]


def test_lost_inserts_are_errors(spark, tmp_path):
    for text in (f"/* open\n{INSERT};\n", f"LOCK x; {INSERT};\n"):
        (tmp_path / "d.sql").write_text(text)
        with pytest.raises(Exception, match="cannot be read"):
            dump.read_dump(spark, str(tmp_path / "d.sql"), "linktarget").collect()


def test_stream_reads_only_its_table(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.sql").write_text("-- dump\nINSERT INTO `linktarget` VALUES (5,0,'no page');\nINSERT INTO `page` VALUES (1,0,'A\\'s',0,0,0.1,'','',1,2,'',NULL),\n(2,0,'B',1,0,0.1,'','',1,2,'',NULL),(3,1,'Talk',0,0,0.1,'','',1,2,'',NULL);\n")
    streams.ingest_pages(spark, str(inbox), str(tmp_path / "store"), str(tmp_path / "check"), wiki_name="w").awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "store")).select("page_id", "page_title", "is_redirect")) == [(1, "A's", False), (2, "B", True)]


def test_tables_of_the_shared_folder(spark):
    made, counted = tables.cut_counting(spark.range(10).toDF("page_id"), low=F.col("page_id") < 3)
    assert counted == {"low": 3} and made.count() == 10 and os.path.isdir(made.cut_at.removeprefix("file:"))
    tables.drop(made)
    assert not os.path.exists(made.cut_at.removeprefix("file:"))
