"""Stores of several wikis and dump dates, and the statistics document in its published shape."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.operators import graph, ingest, serve, stats
from linkloom.functions import scalars


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def store(spark):
    """Two wikis that number from 1 and share titles, and a second dump of one of them."""
    page = spark.createDataFrame([("1", "de", 1, "A", False), ("1", "de", 2, "Bb", False), ("1", "en", 1, "A", True), ("1", "en", 2, "Zzzz", False), ("2", "en", 1, "A", False), ("2", "en", 3, "Zz", False)], "dump_date string, wiki_name string, page_id bigint, page_title string, is_redirect boolean")
    link = spark.createDataFrame([("1", "de", 1, 2), ("1", "de", 2, 1), ("1", "en", 2, 1), ("2", "en", 3, 1), ("2", "en", 1, 3)], "dump_date string, wiki_name string, page_id bigint, page_link bigint")
    return page, link


def test_lookups_name_their_wiki(store):
    page, link = store
    de, en = {"wiki_name": "de", "dump_date": "1"}, {"wiki_name": "en", "dump_date": "1"}
    assert rows(serve.links(page, link, 1, **de)) == [(2, "Bb")] and rows(serve.links(page, link, 1, **en)) == []
    assert rows(serve.neighbours(page, link, 2, **en)) == [(1, 0, 1, "A")] and rows(serve.neighbours(page, link, 2, **de)) == [(1, 1, 1, "A")]
    assert tuple(serve.degree(link, 1, **de).first()) == (1, 1) and tuple(serve.degree(link, 1, **en).first()) == (0, 1)
    assert serve.page_title(page, 2, **de) == "Bb" and serve.page_id(page, "Zz", wiki_name="en", dump_date="2") == 3
    assert serve.is_redirect(page, "A", **en) is True and serve.is_redirect(page, "A", wiki_name="en", dump_date="2") is False
    assert serve.latest_dump(page, "en") == "2" and serve.latest_dump(page, "xx") is None
    assert rows(graph.reached(graph.edges_of(link, **en), [2])) == [(2, 1, 1), (2, 2, 0)]


def test_links_resolve_within_their_wiki(spark, store):
    pagelinks = spark.createDataFrame([("de", 2, 0, 7), ("en", 2, 0, 7)], "wiki_name string, pl_from bigint, pl_from_namespace int, pl_target_id bigint")
    targets = spark.createDataFrame([("de", 7, 0, "A"), ("en", 7, 0, "A")], "wiki_name string, lt_id bigint, lt_namespace int, lt_title string")
    page = store[0].filter("dump_date = '1'").drop("dump_date")
    assert rows(ingest.resolve_links(pagelinks, targets, page)) == [("de", 2, 1), ("en", 2, 1)]
    assert rows(ingest.resolve_links(pagelinks.withColumn("pl_from", F.col("pl_from") + 5), targets, page, require_source=True)) == []
    with pytest.raises(ValueError, match="wiki_name"):
        ingest.resolve_links(pagelinks.drop("wiki_name"), targets, page)


def test_statistics_by_dump_date(store):
    page, link = store
    assert rows(stats.longest_titles(page)) == [("1", "de", 2, "Bb"), ("1", "en", 2, "Zzzz"), ("1", "global", 2, "Zzzz"), ("2", "en", 3, "Zz"), ("2", "global", 3, "Zz")]
    assert rows(stats.extremes(stats.summary(page, link), "num_links")) == [("1", "num_links", "de", 2, "en", 1), ("2", "num_links", "en", 2, "en", 2)]
    made = json.loads(stats.document(page, link, created_at="2024-09-01 00:00:00", dump_date="2").first()[0])
    assert made["num_pages"] == {"en": 2, "global": 2} and made["wikis"] == ["en"]
    first = json.loads(stats.document(page, link, created_at="2024-09-01 00:00:00", dump_date="1").first()[0])
    assert first["max_num_links"] == ["de", 2] and first["min_num_links"] == ["en", 1]  # arrays of name and number
    assert first["longest_name"]["global"] == {"page_id": 2, "page_title": "Zzzz", "wiki_name": "en"}


def test_a_published_document_is_read(spark):
    """A document written by hand in the published shape."""
    page = {"page_id": 5, "page_title": "Q\"[x", "wiki_name": "de"}
    count = {"de": 3, "global": 3}
    hand = {name: count for name in stats.DOCUMENT_COUNTS} | {
        "most_linked": {"de": [page | {"count": 2}], "global": []}, "most_links": {}, "longest_name": {"de": page}, "longest_name_no_redirect": {},
        "max_num_pages": ["de", 3], "min_num_pages": ["de", 3], "max_num_links": ["a\"b", 9], "min_num_links": ["de", 0],
        "created_at": 1, "dump_date": "20240901", "wikis": ["de"], "seconds_taken": 2, "bfs_sample_stats": None,
    }
    found = stats.read_document(spark.createDataFrame([(json.dumps(hand),)], "value string")).first()
    assert tuple(found["max_num_links"]) == ('a"b', 9) and found["longest_name"]["de"]["wiki_name"] == "de" and found["most_linked"]["de"][0]["count"] == 2
    assert ("max_num_links", 'a"b', "9") in rows(stats.document_rows(spark.createDataFrame([(json.dumps(hand),)], "value string")))


def test_sizes_beyond_a_long(spark):
    found = spark.createDataFrame([("99999999 TB",), ("2 GB",), ("x",)], "t string").select(scalars.parse_size(F.col("t"))).collect()
    assert [r[0] for r in found] == [(1 << 63) - 1, 2_000_000_000, None]
