"""Hand-made dumps and graphs with known results."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.functions import scalars
from linkloom.operators import checks, graph, history, ingest, sampling, serve, stats
from linkloom.sources import dump, files
from linkloom.streaming import ingest as streams

PAGES = [(i, c, i == 5) for i, c in enumerate("ABCDEFGH", 1)]
LINKS = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 4), (2, 5), (6, 7), (9, 6), (7, 7)]


@pytest.fixture(scope="module")
def hand(spark):
    page = spark.createDataFrame([("w", *p) for p in PAGES], schemas.PAGE).cache()
    link = spark.createDataFrame([("w", *e) for e in LINKS], schemas.LINK).cache()
    return page, link


def rows(df):
    return sorted(tuple(r) for r in df.collect())


LINKTARGET = """/*!40101 SET x */;
CREATE TABLE `linktarget` (
  `lt_id` bigint(20) unsigned NOT NULL,
  PRIMARY KEY (`lt_id`)
) ENGINE=InnoDB;
INSERT INTO `linktarget` VALUES (3,0,'Main_Page'),(4,0,'DUMMY'),(7,2,'NONARTICLE'),
(2,3,'NONARTICLE3');
"""
PAGELINKS = "INSERT INTO `pagelinks` VALUES (12,0,4), (21,0,3), (42,2,7);\n"
PAGE = (
    "INSERT INTO `page` VALUES (1,0,'Main_Page',0,0,0.5,'20240901000000',NULL,10,20,'wikitext',NULL),"
    "(20,4,'General_disclaimer',1,0,0.25,'20240901000000',NULL,11,21,'wikitext',NULL),(21,4,'About',1,1,1e-3,'20240901000000','20240901000001',12,22,NULL,NULL);\n"
)
ODD = "INSERT INTO `linktarget` VALUES (1,0,'a,b'),(2,0,'(x)'),(3,0,'it\\'s'),(4,0,'back\\\\slash'),(5,-1,NULL),(6,0,'q\\\"q');\r\nINSERT INTO `linktarget` VALUES (7,0,''),(7,0,'');"


@pytest.fixture
def dumps(spark, tmp_path):
    for name, text in (("linktarget", LINKTARGET), ("pagelinks", PAGELINKS), ("page", PAGE)):
        (tmp_path / f"w-20240901-{name}.sql").write_text(text)
    return {name: dump.read_dump(spark, str(tmp_path / f"w-20240901-{name}.sql"), name) for name in ("linktarget", "pagelinks", "page")}


def test_tiny_dump(dumps):
    assert rows(ingest.link_targets(dumps["linktarget"])) == [(3, "Main_Page"), (4, "DUMMY")]
    page = ingest.pages(dumps["page"])
    assert rows(page) == [(1, "Main_Page", False)]
    assert rows(ingest.resolve_links(dumps["pagelinks"], dumps["linktarget"], page)) == [(21, 1)]
    assert rows(ingest.resolve_links(dumps["pagelinks"], dumps["linktarget"], page, require_source=True)) == []
    assert ingest.count_articles(dumps["page"]).first()[0] == 1
    third = dumps["page"].filter("page_id = 21").first()
    assert third["page_random"] == 1e-3 and third["page_content_model"] is None and third["page_latest"] == 12


def test_odd_cells(spark, tmp_path):
    with gzip.open(tmp_path / "w-20240901-linktarget.sql.gz", "wt", newline="") as f:
        f.write(ODD)
    found = dump.read_dump(spark, str(tmp_path), "linktarget")
    expected = [(1, 0, "a,b"), (2, 0, "(x)"), (3, 0, "it's"), (4, 0, "back\\slash"), (5, -1, None), (6, 0, 'q"q'), (7, 0, ""), (7, 0, "")]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == expected
    with pytest.raises(ValueError, match="duplicate"):
        ingest.checked_unique(found, "lt_id")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.sql").write_text("INSERT INTO `page` VALUES (9,0,'no');\nINSERT INTO `linktarget` (`lt_id`, `lt_namespace`, `lt_title`) VALUES (1,0,'one'),(2,\n0,'two');\n")
    assert rows(dump.read_dump(spark, str(tmp_path / "cut"), "linktarget")) == [(1, 0, "one"), (2, 0, "two")]
    (tmp_path / "cut" / "x.sql").write_text("INSERT INTO `linktarget` VALUES (1,0,'one'),(2,0,'tw;\n")
    with pytest.raises(Exception, match="cannot read"):
        dump.read_dump(spark, str(tmp_path / "cut"), "linktarget").collect()
    assert rows(dump.part(found, 3, 2, ["lt_id"]).select("lt_id")) == [(4,), (5,), (6,)]


def test_hand_stats(hand):
    page, link = hand
    total = stats.summary(page, link).filter("wiki_name = 'global'").first().asDict()
    assert total == {"wiki_name": "global", "num_pages": 8, "num_redirects": 1, "num_links": 10, "num_linked_redirects": 1, "num_dead": 1, "num_orphan": 1, "num_dead_orphan": 1}
    assert rows(stats.dead_orphans(page, link).select("page_id")) == [(8,)]
    assert [tuple(r) for r in stats.top_degrees(page, link, "page_link", 2).orderBy(F.desc("n"), "page_id").collect()] == [(4, "D", 3, "w"), (7, "G", 2, "w")]


def test_wikis_that_use_the_same_ids(spark):
    page = spark.createDataFrame([("de", 1, "A", False), ("de", 2, "B", False), ("en", 1, "A", True), ("en", 2, "C", False)], schemas.PAGE)
    link = spark.createDataFrame([("de", 1, 2), ("de", 2, 1)], schemas.LINK)
    counts = {r["wiki_name"]: tuple(r)[1:] for r in stats.summary(page, link).collect()}
    assert counts == {"de": (2, 0, 2, 0, 0, 0, 0), "en": (2, 1, 0, 0, 2, 2, 2), "global": (4, 1, 2, 0, 2, 2, 2)}
    assert stats.linked_redirects(page, link).isEmpty()
    assert rows(stats.dead_pages(page, link).select("wiki_name", "page_id")) == [("en", 1), ("en", 2)]
    assert rows(stats.orphan_pages(page, link).select("wiki_name", "page_id")) == [("en", 1), ("en", 2)]
    assert rows(stats.top_degrees(page, link, "page_link")) == [(1, "A", 1, "de"), (2, "B", 1, "de")]
    dated = [df.withColumn("dump_date", F.lit("20240801")).union(df.filter("wiki_name = 'en'").withColumn("dump_date", F.lit("20240901"))) for df in (page, link)]
    assert {(r["dump_date"], r["wiki_name"]): r["num_dead"] for r in stats.summary(*dated).collect()} == {("20240801", "de"): 0, ("20240801", "en"): 2, ("20240801", "global"): 2, ("20240901", "en"): 2, ("20240901", "global"): 2}
    fresh = stats.summary(page, link).filter("wiki_name = 'de'").withColumn("num_links", F.lit(9).cast("bigint"))
    assert {r["wiki_name"]: r["num_links"] for r in stats.merged_stats(stats.summary(page, link), fresh).collect()} == {"de": 9, "en": 0, "global": 2}


def test_document_round_trip(spark, hand, tmp_path):
    page, link = hand
    made = stats.document(page, link, created_at="2024-09-01 00:00:00", dump_date="20240901", seconds_taken=7, local_sizes=spark.createDataFrame([("w", 5)], "wiki_name string, bytes bigint"))
    files.write_document(made, str(tmp_path / "20240901"))
    found = stats.read_document(spark.read.text(str(tmp_path / "20240901"))).first()
    assert found["num_links"] == {"w": 10, "global": 10} and found["wikis"] == ["w"] and found["dump_date"] == "20240901" and found["seconds_taken"] == 7
    assert [(p["page_id"], p["page_title"], p["count"]) for p in found["most_linked"]["global"]][:2] == [(4, "D", 3), (7, "G", 2)]
    assert tuple(found["max_num_links"]) == ("w", 10) and found["longest_name"]["w"]["page_id"] == 1
    assert '"local_wiki_sizes":[{"wiki_name":"w","bytes":5}]' in made.first()[0]


def test_hand_bfs(hand):
    edges = graph.edges_of(hand[1])
    found = graph.bfs(edges, [1, 4, 8]).cache()
    assert rows(graph.histogram(found)) == [(1, 1, 2), (1, 2, 2), (4, 1, 1), (4, 2, 2), (4, 3, 1)]
    assert rows(graph.reach(found).select("source_id", "num_visited", "eccentricity", "deepest").na.fill(-1)) == [(1, 4, 2, 4), (4, 4, 3, 5), (8, 0, 0, -1)]
    assert graph.path_to(found, 4, 5) == [4, 1, 2, 5] and graph.path_to(found, 1, 8) == [8]
    assert graph.bfs(edges, [1], max_depth=1).count() == 3


def test_hand_paths(hand):
    edges = graph.edges_of(hand[1])
    for start, end, expected in ((1, 4, [[1, 2, 4], [1, 3, 4]]), (2, 4, [[2, 4]]), (4, 5, [[4, 1, 2, 5]]), (1, 8, []), (3, 3, [[3]]), (7, 7, [[7]])):
        assert sorted(r[0] for r in graph.shortest_paths(edges, start, end).collect()) == expected
    assert [r.get("visited") for r in graph.shortest_path_stream(edges, 1, 4)][-1] == 2
    with pytest.raises(ValueError, match="more than 1"):
        graph.shortest_paths(edges, 1, 4, max_paths=1)


def test_hand_components(hand):
    page, link = hand
    labels = graph.components(graph.edges_of(link)).cache()
    assert rows(labels) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6), (9, 6)]
    assert [tuple(r) for r in graph.pruned_components(labels, page).collect()] == [(6, 3, [6, 7, 9])]


def test_sampling(hand):
    found = graph.bfs(graph.edges_of(hand[1]), [1, 6])
    average = sampling.average_histogram(graph.histogram(found), 8)
    assert [tuple(round(x, 6) for x in r) for r in sorted(average.collect())] == [(1, 0.1875, 0.088388), (2, 0.25, 0.0)]
    assert [r["cdf"] for r in sampling.cumulative(average).orderBy("depth").collect()] == [0.1875, 0.4375]
    assert sampling.depth_for(sampling.cumulative(average), 0.9).collect() == []
    with pytest.raises(ValueError):
        sampling.depth_for(average, 0)
    values = hand[0].sparkSession.createDataFrame([(1, 1, 4), (2, 6, 1), (3, 4, 4)], "place int, key int, value int")
    assert tuple(sampling.max_min_avg(values).first()) == (6, 1, 1, 4, 3.0, 3.25)
    assert rows(sampling.sample_pages(hand[0], 3)) == rows(sampling.sample_pages(hand[0], 3))
    pairs = values.sparkSession.createDataFrame([(1, 5), (1, 8), (1, 1)], "source_id bigint, target_id bigint")
    assert rows(sampling.path_lengths(found, pairs).select("target_id", "n_nodes")) == [(5, 3), (8, 0)]


def test_serving(hand):
    page, link = hand
    assert serve.page_id(page, "C") == 3 and serve.page_id(page, "Z") is None and serve.page_title(page, 5) == "E"
    assert serve.is_redirect(page, "E") is True and serve.is_redirect(page, "Z") is None
    assert rows(serve.links(page, link, 6, incoming=True)) == [(9, None)]
    assert rows(serve.neighbours(page, link, 1).select("linked_id", "num_links", "times_linked")) == [(2, 2, 1), (3, 1, 1)]
    with pytest.raises(ValueError):
        serve.neighbours(page, link, 1, sort="name")
    nodes, edges = graph.ego(link, 1, neighbours=1)
    assert rows(nodes) == [(1, 0), (2, 1), (4, 2)] and rows(edges) == [(1, 2), (2, 4)]


def test_history_and_checks(spark):
    series = spark.createDataFrame([("w", "s", d, v) for d, v in enumerate([10, None, 12, 12, 0, 5])], "wiki_name string, stat string, dump_date int, value int")
    assert [tuple(r) for r in history.trend(series).orderBy("dump_date").select("change", "percent", "direction").collect()] == [
        (None, None, None), (None, None, None), (2, 20.0, "up"), (0, 0.0, "no change"), (-12, -100.0, "down"), (5, 0.0, "up"),
    ]
    day = datetime.date
    evidence = spark.createDataFrame(
        [("missing", day(2024, 1, 5), None, None, True), ("missing", None, None, None, False), ("missing", None, None, None, True), ("outdated", None, None, day(2024, 1, 5), False), ("outdated", None, None, None, False)],
        "change string, added_at date, created_at date, deleted_at date, in_old_revision boolean",
    ).withColumn("dump_date", F.lit(day(2024, 1, 1)))
    assert [r["excuse"] for r in checks.verdicts(evidence).collect()] == ["added after dump", "absent from old revision", None, "deleted after dump", None]
    tasks = spark.createDataFrame([("a", "2", "DONE"), ("b", None, "QUEUED"), ("c", "1", "RUNNING"), ("d", "3", "DONE")], "name string, dump_date string, status string").withColumn("started_at", F.lit(None).cast("timestamp"))
    assert [r["name"] for r in checks.task_order(tasks).collect()] == ["c", "b", "d", "a"]
    assert checks.is_subset(tasks.limit(1), tasks, ["name"]) and not checks.is_subset(tasks, tasks.limit(1), ["name"])


SIZES = [("26.7 GB", 26700000000), ("512 MB", 512000000), ("1024 KB", 1024000), ("2048 Bytes", 2048), ("1.5 TB", 1500000000000), ("1000 b", 1000), ("5 KB", 5000), ("26.7GB", None), ("512 mb", None), ("5 kb", None), (" 7  MB and more", 7000000), ("0.5 MB", 500000), ("1.234 GB", 1234000000), ("Invalid Unit", None), ("1234", None), ("1000", None)]


def test_scalars(spark):
    sizes = spark.createDataFrame(SIZES, "text string, bytes bigint")
    assert all(r[0] == r[1] for r in sizes.select("bytes", scalars.parse_size(F.col("text"))).collect())
    one = spark.range(1)
    row = one.select(
        scalars.length_characters(F.lit("a😀é")), scalars.length_bytes(F.lit("a😀é")), scalars.length_utf16(F.lit("a😀é")),
        scalars.dump_date(F.lit("20240901")), scalars.dump_date(F.lit("2024")), scalars.wiki_prefix(F.lit("enwiktionary")),
        scalars.grouped(F.lit(-1234567)), scalars.si_suffix(F.lit(1530000)), scalars.format_bytes(F.lit(1536)), scalars.slug(F.lit("A B")), scalars.unslug(F.lit("a-b")),
        scalars.map_range(F.lit(5), F.lit(0), F.lit(10), 10.0, 20.0), scalars.percentage(F.lit(1), F.lit(0)), scalars.rgb_hex(F.lit(255)), scalars.is_wiki_type(F.lit("dewiki")),
    ).first()
    assert tuple(row) == (3, 7, 4, datetime.date(2024, 9, 1), None, "en", "-1_234_567", "1.5M", "1.5 KB", "a-b", "A b", 15.0, None, "#0000ff", True)
    times = one.select(scalars.time_difference(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")).alias("t")).first()["t"]
    assert tuple(times) == (2, "day")
    with pytest.raises(Exception, match="unknown wiki type"):
        one.select(scalars.wiki_prefix(F.lit("foo"))).collect()


def test_large_sizes(spark):
    found = spark.createDataFrame([(0,), (1023,), (1 << 50,), (1 << 62,), (1536 << 40,)], "n bigint").select(scalars.format_bytes(F.col("n"))).collect()
    assert [r[0] for r in found] == ["0 Bytes", "1,023 Bytes", "1 PB", "4 EB", "1.5 PB"]


def test_files(spark, tmp_path, hand):
    page, link = hand
    files.write_store(page.withColumn("dump_date", F.lit("20240901")), str(tmp_path / "store"), bloom="page_title")
    assert rows(files.wikis(spark, str(tmp_path / "store"))) == [("w",)]
    vertices, edges = page.select(F.col("page_id").alias("id"), F.concat(F.col("page_title"), F.lit('<&"')).alias("label")), graph.edges_of(link)
    files.write_graphml(vertices, edges, str(tmp_path / "g.xml"))
    nodes, arcs = files.read_graphml(spark, str(tmp_path / "g.xml"))
    assert rows(nodes) == rows(vertices) and rows(arcs) == rows(edges)
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps" / "dewiki-20240901-page.sql").write_text("abc")
    assert rows(files.file_sizes(spark, str(tmp_path / "dumps"))) == [("dewiki", "page", 3)]
    sums = spark.createDataFrame([("0" * 32 + "  dewiki-20240901-page.sql",)], "value string")
    assert files.md5_mismatches(spark, str(tmp_path / "dumps"), sums).count() == 1
    files.write_csv(page, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 8
    views = spark.createDataFrame([('{"items":[{"articles":[{"article":"A","views":5,"rank":1},{"article":"X:Y","views":4,"rank":2}]}]}',)], "value string")
    assert rows(serve.popular_pages(files.page_views(views), page, 5).select("page_id")) == [(1,)]
    api = spark.createDataFrame([('{"query":{"pages":[{"pageid":3,"title":"C"}]}}',)], "value string")
    assert rows(files.api_pages(api)) == [(3, "C")]


def test_streaming_reads_files_once(spark, tmp_path):
    inbox, store, state = (str(tmp_path / x) for x in ("inbox", "store", "state"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.sql").write_text(PAGE)
    for _ in range(2):
        streams.ingest_pages(spark, inbox, store, state, wiki_name="w").awaitTermination(60)
    assert spark.read.parquet(store).count() == 1
    (tmp_path / "inbox" / "b.sql").write_text(PAGE.replace("(1,0,", "(2,0,"))
    streams.ingest_pages(spark, inbox, store, state, wiki_name="w").awaitTermination(60)
    assert rows(spark.read.parquet(store).select("page_id")) == [(1,), (2,)]


def test_small_relations(spark):
    dumps = spark.createDataFrame([("a", "20240901"), ("b", "20240901"), ("a", "20241001"), ("c", None)], "wiki_name string, dump_date string")
    assert rows(checks.enqueue(dumps, ["a", "b"])) == [("a", "20240901", ["a", "b"]), ("a", "20241001", ["a", "b"]), ("b", "20240901", ["a", "b"])]
    assert rows(checks.enqueue(dumps.limit(0), ["a"])) == []
    kinds = spark.createDataFrame([("a", 1, "download", 5), ("a", 1, "store", 0), ("b", 1, "download", 5), ("b", 1, "store", 9), ("c", 1, "store", 9)], "wiki_name string, dump_date int, kind string, size int")
    assert rows(checks.unprocessed(kinds)) == [("a", 1)]
    paths = spark.createDataFrame([([1, 2, 9],), ([1],)], "path array<bigint>")
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "page_id bigint, page_title string")
    assert sorted(map(tuple, graph.path_titles(paths, titles).select("path", "titles").collect())) == [([1], ["A"]), ([1, 2, 9], ["A", "B", None])]


def test_walk_up(spark):
    edges = spark.createDataFrame([(3, 2), (3, 4), (2, 3), (4, 1), (5, 6), (6, 5)], "src bigint, dst bigint")
    starts = spark.createDataFrame([(3,), (4,), (5,), (1,), (9,)], "page_id bigint")
    assert rows(graph.walk_up(edges, starts, 1)) == [(1, [1], True), (3, [3, 2], False), (4, [4, 1], True), (5, [5, 6], False), (9, [9], False)]


def test_arrays_and_maps(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()[0]

    numbers = F.array(*map(F.lit, range(7)))
    assert value(scalars.chunks(numbers, 3)) == [[0, 1, 2], [3, 4], [5, 6]]
    assert value(scalars.chunks(F.array(F.lit(1)), 3)) == [[1], [], []]
    assert value(scalars.inner(numbers)) == [1, 2, 3, 4, 5] and value(scalars.inner(F.array(F.lit(1)))) == []
    assert value(scalars.second_last(numbers)) == 5 and value(scalars.second_last(F.array(F.lit(1)))) is None
    assert value(scalars.merge_lists(numbers, F.array(F.lit(9), F.lit(0)))) == [*range(7), 9]
    left, right = (F.create_map(*map(F.lit, x)) for x in (["a", 1, "b", 2], ["b", 3, "c", 4]))
    assert value(scalars.merge_maps(left, right)) == {"a": 1, "b": 3, "c": 4}
    nested = scalars.merge_maps(F.create_map(F.lit("k"), left), F.create_map(F.lit("k"), right), depth=2)
    assert value(nested) == {"k": {"a": 1, "b": 3, "c": 4}}
    assert value(scalars.is_schedule(F.lit(" 0 3  * * 1 "))) and not value(scalars.is_schedule(F.lit("0 3 * *")))
    at = F.lit("2024-09-01 06:00:00").cast("timestamp")
    assert value(scalars.within_hours(at, 6, 7)) and not value(scalars.within_hours(at, 2, 6)) and not value(scalars.within_hours(at, None, 7))
