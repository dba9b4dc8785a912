"""Statistics that follow new links, exactly once."""

import os

from linkloom.operators import stats
from linkloom.sources import files
from linkloom.streaming import statistics

PAGE = "dump_date string, wiki_name string, page_id bigint, page_title string, is_redirect boolean"
LINK = "dump_date string, wiki_name string, page_id bigint, page_link bigint"


def times(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_table_follows_new_links(spark, tmp_path):
    pages, links, table, check = (str(tmp_path / n) for n in ("pages", "links", "stats", "check"))

    def store(wiki, n, date="d1"):
        files.write_store(spark.createDataFrame([(date, wiki, i, f"{wiki}{i}", i % 3 == 0) for i in range(1, n + 1)], PAGE), pages)
        files.write_store(spark.createDataFrame([(date, wiki, i, i % n + 1) for i in range(1, n)], LINK), links)

    def run():
        schema = spark.createDataFrame([], LINK).schema
        statistics.follow_links(spark, pages, links, schema, table, check).awaitTermination()
        return {(r["dump_date"], r["wiki_name"]): tuple(r)[2:] for r in statistics.read_table(spark, table).collect()}

    def whole():
        key = lambda r: (str(r["dump_date"]), r["wiki_name"])
        return {key(r): tuple(r[c] for c in statistics.COUNTS) for r in stats.summary(spark.read.parquet(pages), spark.read.parquet(links)).collect()}

    store("de", 5)
    store("en", 4)
    first = run()
    assert first == whole() and set(first) == {("d1", "de"), ("d1", "en"), ("d1", "global")}
    before = times(table)
    assert run() == first and times(table) == before  # nothing is new
    store("fr", 6)
    second = run()
    assert second == whole() and {k for k in second if second[k] != first.get(k)} == {("d1", "fr"), ("d1", "global")}
    after = times(table)
    assert all(after[f] == t for f, t in before.items() if "global" not in f)  # other wikis' files stay
    store("de", 3, "d2")
    assert run() == whole()
    again = times(table)
    statistics.refresh(spark.read.parquet(pages), spark.read.parquet(links), table, spark.createDataFrame([("d2", "de")], "dump_date string, wiki_name string"))
    assert {(r["dump_date"], r["wiki_name"]): tuple(r)[2:] for r in statistics.read_table(spark, table).collect()} == whole() and len(times(table)) == len(again)
