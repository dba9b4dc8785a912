"""Functions that no registered query runs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import scalars
from linkloom.operators import history, ingest, stats
from linkloom.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_relations(spark):
    pairs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, t int")
    assert rows(ingest.last_map(pairs, "k", "v", "t")) == [(1, "b"), (2, "c")]
    record = spark.createDataFrame([("de", 1)], "wiki_name string, n bigint")
    assert rows(stats.missing_stats(record, spark.createDataFrame([("de",), ("en",)], "wiki_name string"))) == [("en",)]
    summary = spark.createDataFrame([("de", 1, None), ("en", 2, 3)], "wiki_name string, a bigint, b bigint")
    assert rows(history.long_form(summary, "d")) == sorted([("d", "de", "a", 1), ("d", "de", "b", None), ("d", "en", "a", 2), ("d", "en", "b", 3)], key=repr)


def test_files(spark, tmp_path):
    (tmp_path / "20240901.json").write_text(json.dumps({"n": 3}))
    found = files.read_snapshots(spark, str(tmp_path / "20240901.json"), T.StructType([T.StructField("n", T.LongType())]))
    assert rows(found.select("n", "dump_date")) == [(3, "20240901")]
    (tmp_path / "20240902.json").write_text(json.dumps({"n": "three"}))
    with pytest.raises(Exception, match="three|MALFORMED|FAILED"):
        files.read_snapshots(spark, str(tmp_path / "20240902.json"), T.StructType([T.StructField("n", T.LongType())])).collect()
    (tmp_path / "c.csv").write_text("comm_id, page_id\n0,12\n1,13\n")
    assert rows(files.communities_csv(spark, str(tmp_path / "c.csv"))) == [(0, "12"), (1, "13")]
    assert json.loads(files.schema_json(T.StructType([T.StructField("n", T.LongType())])))["fields"][0]["name"] == "n"
    page = spark.createDataFrame([('<a href="dewiki-20240901-pagelinks.sql.gz">x</a> dewiki-20240901-page.sql.gz dewiki-20240901.txt',)], "h string")
    assert page.select(files.dump_files_listed(F.col("h"))).first()[0] == ["pagelinks", "page"]


def test_scalars(spark):
    one = spark.createDataFrame([("A_b c", "dewiki", "x <ins class='k'>New [[T]]</ins> <DEL>old</DEL>")], "t string, w string, h string")
    found = one.select(scalars.spaces(F.col("t")), scalars.page_url(F.col("w"), F.col("t")), scalars.titles_in_diff(F.col("h"), "ins"), scalars.titles_in_diff(F.col("h"), "del")).first()
    assert tuple(found) == ("A b c", "https://de.wikipedia.org/wiki/A_b_c", ["New [[T]]"], ["old"])
    mentioned = one.select(scalars.mentioned(F.array(F.lit("see [[T]]"), F.lit("y")), F.lit("[[T]]")), scalars.mentioned(F.array().cast("array<string>"), F.lit("T"))).first()
    assert tuple(mentioned) == (True, False)
    places = [r[0] for r in spark.range(50).select(scalars.palette_index(F.col("id"), 7)).collect()]
    assert set(places) <= set(range(7)) and len(set(places)) > 3
    assert places == [r[0] for r in spark.range(50).select(scalars.palette_index(F.col("id"), 7)).collect()]
