"""All registered queries of the link-graph engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import checks, communities, graph, history, ingest, sampling, serve, stats, tables, trees, validation
from ..sources import api, files, index, search
from ..streaming import ingest as streams
from .adapters import PAGE_SQL, SNAPSHOT_SQL, START_SQL, WIKI_SQL, links, orders_graph, pages, snapshots, start_page, table, wiki_links, wiki_pages, with_graph, with_wikis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Levels that recursive SQL follows; deeper than any test graph of the default kind.
DEPTH = 45


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def on_graph(name: str, sql: str | None = None):
    """A query over (page, link) of the default graph."""

    def keep(f):
        register(name, sql)(lambda spark, d: f(pages(spark, d), links(spark, d)))
        return f

    return keep


def by_wiki(expression: str, name: str, source: str) -> str:
    return f"SELECT coalesce(wiki_name, 'global') AS wiki_name, {expression} AS {name} FROM {source} GROUP BY ROLLUP (wiki_name)"


def as_doubles(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts that can be unknown as doubles, which both engines give alike."""
    return rows.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns})


# Statistics, over wikis that use the same ids


def on_wikis(name: str, sql: str):
    """A query over (page, link) of several wikis."""

    def keep(f):
        register(name, sql)(lambda spark, d: f(wiki_pages(spark, d), wiki_links(spark, d)))
        return f

    return keep


on_wikis("num_pages", with_wikis(by_wiki("count(*)", "num_pages", "page")))(lambda p, l: stats.page_counts(p).select("wiki_name", "num_pages"))
on_wikis("num_redirects", with_wikis(by_wiki("count(*) FILTER (is_redirect)", "num_redirects", "page")))(lambda p, l: stats.page_counts(p).select("wiki_name", "num_redirects"))
on_wikis("num_links", with_wikis(by_wiki("count(*)", "num_links", "link")))(lambda p, l: stats.link_counts(l))
_TO_REDIRECT = "(wiki_name, page_link) IN (SELECT (wiki_name, page_id) FROM page WHERE is_redirect)"
on_wikis("num_linked_redirects", with_wikis(by_wiki("count(*)", "num_linked_redirects", f"(SELECT * FROM link WHERE {_TO_REDIRECT})")))(stats.linked_redirects)
for _name, _by in (("most_linked", "page_link"), ("most_links", "page_id")):
    on_wikis(_name, with_wikis(f"SELECT t.wiki_name, t.page_id, page_title, n FROM (SELECT wiki_name, {_by} AS page_id, count(*) AS n FROM link GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10) t LEFT JOIN page p ON t.page_id = p.page_id AND t.wiki_name = p.wiki_name"))(lambda p, l, by=_by: stats.top_degrees(p, l, by))
on_wikis("most_linked_by_wiki", with_wikis("SELECT wiki_name, page_id, n, place FROM (SELECT wiki_name, page_link AS page_id, count(*) AS n, row_number() OVER (PARTITION BY wiki_name ORDER BY count(*) DESC, page_link)::INTEGER AS place FROM link GROUP BY 1, 2) WHERE place <= 10"))(lambda p, l: stats.top_degrees_by_wiki(l, "page_link"))
_LONGEST = """best AS (SELECT wiki_name, page_id, page_title FROM (
  SELECT *, row_number() OVER (PARTITION BY wiki_name ORDER BY length(page_title) DESC, page_id) AS k FROM page {where}) WHERE k = 1)
SELECT * FROM best UNION ALL (SELECT 'global', page_id, page_title FROM best ORDER BY strlen(page_title) DESC, page_id, wiki_name LIMIT 1)"""
for _name, _where in (("longest_name", ""), ("longest_name_no_redirect", "WHERE NOT is_redirect")):
    on_wikis(_name, f"WITH {WIKI_SQL}, " + _LONGEST.format(where=_where))(lambda p, l, r=not _where: stats.longest_titles(p, redirects=r))
_DEAD = "(wiki_name, page_id) NOT IN (SELECT (wiki_name, page_id) FROM link)"
_ORPHAN = "(wiki_name, page_id) NOT IN (SELECT (wiki_name, page_link) FROM link)"
for _name, _where in (("num_dead", _DEAD), ("num_orphan", _ORPHAN), ("num_dead_orphan", f"{_DEAD} AND {_ORPHAN}")):
    on_wikis(_name, with_wikis(by_wiki(f"count(*) FILTER ({_where})", _name, "page")))(lambda p, l, c=_name: stats.missing_counts(p, l).select("wiki_name", c))
on_wikis("dead_pages", with_wikis(f"SELECT * FROM page WHERE {_DEAD}"))(stats.dead_pages)
on_wikis("orphan_pages", with_wikis(f"SELECT * FROM page WHERE {_ORPHAN}"))(stats.orphan_pages)
on_wikis("dead_orphan_list", with_wikis(f"SELECT * FROM page WHERE {_DEAD} AND {_ORPHAN} ORDER BY wiki_name, page_id LIMIT 20"))(lambda p, l: stats.dead_orphans(p, l).orderBy("wiki_name", "page_id").limit(20))
_SUMMARY = f"""summary AS (SELECT p.*, coalesce(num_links, 0) AS num_links, coalesce(num_linked_redirects, 0) AS num_linked_redirects FROM
 ({by_wiki("count(*)", "num_pages, count(*) FILTER (is_redirect) AS num_redirects, count(*) FILTER (" + _DEAD + ") AS num_dead, count(*) FILTER (" + _ORPHAN + ") AS num_orphan, count(*) FILTER (" + _DEAD + " AND " + _ORPHAN + ") AS num_dead_orphan", "page")}) p
 LEFT JOIN ({by_wiki("count(*)", "num_links, count(*) FILTER (" + _TO_REDIRECT + ") AS num_linked_redirects", "link")}) l USING (wiki_name))"""
on_wikis("stats_rollup_global", with_wikis("SELECT wiki_name, num_pages, num_redirects, num_links, num_linked_redirects, num_dead, num_orphan, num_dead_orphan FROM summary", _SUMMARY))(stats.summary)
on_wikis("max_min_wiki", with_wikis("""SELECT 'num_links' AS stat, arg_min(wiki_name, (-num_links, wiki_name)) AS max_wiki, max(num_links) AS max_value,
  arg_min(wiki_name, (num_links, wiki_name)) AS min_wiki, min(num_links) AS min_value FROM summary WHERE wiki_name <> 'global'""", _SUMMARY))(lambda p, l: stats.extremes(stats.summary(p, l), "num_links"))


def _document_sql() -> str:
    """(stat, wiki_name, value) of the whole document."""
    more, rows = [_SUMMARY], [f"SELECT '{name}', wiki_name, {column}::VARCHAR FROM summary" for name, column in stats.DOCUMENT_COUNTS.items()]
    for name, by in (("most_linked", "page_link"), ("most_links", "page_id")):
        more.append(f"""{name} AS (SELECT * FROM (SELECT wiki_name, {by} AS page_id, count(*) AS n, row_number() OVER (PARTITION BY wiki_name ORDER BY count(*) DESC, {by}) AS place FROM link GROUP BY 1, 2) WHERE place <= 10)""")
        entry = "string_agg(wiki_name || ':' || page_id || ':' || n, ',' ORDER BY n DESC, wiki_name, page_id)"
        rows += [f"SELECT '{name}', wiki_name, {entry} FROM {name} GROUP BY wiki_name", f"SELECT '{name}', 'global', {entry} FROM (SELECT * FROM {name} ORDER BY n DESC, wiki_name, page_id LIMIT 10)"]
    for name, where in (("longest_name", ""), ("longest_name_no_redirect", "WHERE NOT is_redirect")):
        rows.append(f"SELECT '{name}', wiki_name, page_title FROM (WITH {_LONGEST.format(where=where)})")
    for stat in ("num_pages", "num_links"):
        rows += [f"SELECT '{side}_{stat}', arg_min(wiki_name, ({sign}{stat}, wiki_name)), {side}({stat})::VARCHAR FROM summary WHERE wiki_name <> 'global'" for side, sign in (("max", "-"), ("min", ""))]
    return with_wikis("SELECT * FROM (" + "\nUNION ALL ".join(rows) + ") t(stat, wiki_name, value)", *more)


on_wikis("stats_document", _document_sql())(lambda p, l: stats.document_rows(stats.document(p, l, created_at="2024-09-01 00:00:00", dump_date="20240901")))
on_wikis("degree_histogram", with_wikis("SELECT degree, count(*) AS num_pages FROM (SELECT wiki_name, page_id, count(*) AS degree FROM link GROUP BY 1, 2) GROUP BY 1"))(lambda p, l: stats.degree_histogram(l))
register("endpoint_degrees", "WITH " + "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")(
    lambda s, d: (lambda e: e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("n")))(table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct())
)

# Ingest

register("duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: ingest.duplicates(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"))
register("distinct_count", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")(lambda s, d: table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("n")))


@register(
    "link_resolution",
    """WITH pagelinks AS (SELECT o_orderkey AS pl_from, o_orderkey % 3 AS pl_from_namespace, o_custkey AS pl_target_id FROM orders),
linktarget AS (SELECT c_custkey AS lt_id, c_nationkey % 2 AS lt_namespace, c_name AS lt_title FROM customer),
page AS (SELECT c_custkey + 1000000 AS page_id, c_name AS page_title FROM customer WHERE c_custkey % 4 <> 0)
SELECT pl_from AS page_id, page.page_id AS page_link FROM pagelinks JOIN linktarget ON pl_target_id = lt_id JOIN page ON lt_title = page_title
WHERE pl_from_namespace = 0 AND lt_namespace = 0""",
)
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    pagelinks = table(spark, d, "orders").select(F.col("o_orderkey").alias("pl_from"), (F.col("o_orderkey") % 3).alias("pl_from_namespace"), F.col("o_custkey").alias("pl_target_id"))
    targets = customer.select(F.col("c_custkey").alias("lt_id"), (F.col("c_nationkey") % 2).alias("lt_namespace"), F.col("c_name").alias("lt_title"))
    raw = customer.select((F.col("c_custkey") + 1_000_000).alias("page_id"), F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0).alias("page_namespace"), F.col("c_name").alias("page_title"), F.lit(0).alias("page_is_redirect"))
    return ingest.resolve_links(pagelinks, targets, ingest.pages(raw))


register("title_map", "SELECT p_name AS page_title, min(p_partkey) AS page_id FROM part GROUP BY 1")(lambda s, d: ingest.title_map(table(s, d, "part").select(F.col("p_name").alias("page_title"), F.col("p_partkey").alias("page_id"))))
on_graph("adjacency", with_graph("SELECT page_id, list_sort(list(page_link))::VARCHAR AS neighbours FROM link GROUP BY 1"))(lambda p, l: ingest.adjacency(l).select("page_id", F.concat(F.lit("["), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ", "), F.lit("]")).alias("neighbours")))

# Serving

on_graph("neighbours_ranked", with_graph("""SELECT t.linked_id, num_links, times_linked, page_title FROM (
  SELECT linked_id, (SELECT count(*) FROM link WHERE page_id = linked_id) AS num_links, (SELECT count(*) FROM link WHERE page_link = linked_id) AS times_linked
  FROM (SELECT page_link AS linked_id FROM link WHERE page_id = (SELECT page_id FROM start)) ORDER BY times_linked DESC, linked_id LIMIT 5) t LEFT JOIN page p ON p.page_id = t.linked_id""", START_SQL))(
    lambda p, l: serve.neighbours(p, l, start_page(l), limit=5)
)
register("links_page2", """WITH l AS (SELECT DISTINCT l_partkey AS page_id, l_suppkey AS page_link FROM lineitem), top AS (SELECT page_link FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT linked_id, p_name AS page_title FROM (SELECT page_id AS linked_id FROM l WHERE page_link = (SELECT page_link FROM top) ORDER BY 1 LIMIT 50 OFFSET 50) t LEFT JOIN part ON p_partkey = linked_id""")(
    lambda s, d: _links_page(s, d, 2)
)


def _links_page(spark: SparkSession, d: str, number: int) -> DataFrame:
    link = table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.col("l_suppkey").alias("page_link")).distinct()
    top = link.groupBy("page_link").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_link").first()["page_link"]
    page = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("page_title"))
    return serve.links(page, link, top, incoming=True, number=number)


on_graph("degree_point", with_graph("SELECT count(*) FILTER (page_id = s) AS num_links, count(*) FILTER (page_link = s) AS times_linked FROM link, (SELECT page_id AS s FROM start)", START_SQL))(lambda p, l: serve.degree(l, start_page(l)))
register("prefix_search", f"WITH {PAGE_SQL} SELECT * FROM page WHERE starts_with(lower(page_title), 'red w') ORDER BY page_title, page_id LIMIT 100")(lambda s, d: serve.pages_with_prefix(pages(s, d), "Red w"))
register("prefix_search_wildcards", f"WITH {PAGE_SQL} SELECT * FROM page WHERE lower(page_title) LIKE 'r_d%' ORDER BY page_title, page_id LIMIT 100")(lambda s, d: serve.pages_with_prefix(pages(s, d), "R_d", wildcards=True))
register("fuzzy_search", f"WITH {PAGE_SQL} SELECT *, levenshtein(lower(page_title), 'blue ring #7')::INTEGER AS distance FROM page ORDER BY distance, page_id LIMIT 20")(lambda s, d: serve.similar_titles(pages(s, d), "Blue ring #7"))
register("popular_pages", f"WITH {PAGE_SQL}, views AS (SELECT p_name || ' #' || p_partkey AS article, rank() OVER (ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part) SELECT article, rank, page_id FROM views JOIN page ON article = page_title WHERE NOT contains(article, ':') ORDER BY rank LIMIT 10")(
    lambda s, d: serve.popular_pages(_views(s, d), pages(s, d), 10)
)


def _views(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "part")
    return rows.select(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("article"), F.rank().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))


# Graph

_BFS = f"""reach(page_id, depth) AS (SELECT page_id, 0 FROM start UNION SELECT e.page_link, depth + 1 FROM reach r JOIN link e ON r.page_id = e.page_id WHERE depth < {DEPTH}),
tree AS (SELECT page_id, min(depth)::INTEGER AS depth FROM reach GROUP BY 1)"""
on_graph("bfs_depths", with_graph("""SELECT t.page_id, t.depth, (SELECT min(p.page_id) FROM tree p JOIN link e ON e.page_id = p.page_id WHERE e.page_link = t.page_id AND p.depth = t.depth - 1)::DOUBLE AS previous_id FROM tree t""", START_SQL, _BFS, recursive=True))(
    lambda p, l: graph.bfs(graph.edges_of(l), [start_page(l)]).select("page_id", "depth", F.col("previous_id").cast("double"))
)
on_graph("bfs_histogram", with_graph("SELECT depth, count(*) AS n FROM tree WHERE depth > 0 GROUP BY 1", START_SQL, _BFS, recursive=True))(lambda p, l: graph.histograms(graph.edges_of(l), [start_page(l)]).select("depth", "n"))
on_graph("bfs_bounded", with_graph("SELECT page_id, depth FROM tree WHERE depth <= 3", START_SQL, _BFS, recursive=True))(lambda p, l: graph.reached(graph.edges_of(l), [start_page(l)], max_depth=3).select("page_id", "depth"))
on_graph("bfs_undirected", with_graph("SELECT page_id, min(depth)::INTEGER AS depth FROM reach GROUP BY 1", START_SQL, "both_ways AS (SELECT page_id, page_link FROM link UNION SELECT page_link, page_id FROM link)",
    "reach(page_id, depth) AS (SELECT page_id, 0 FROM start UNION SELECT e.page_link, depth + 1 FROM reach r JOIN both_ways e ON r.page_id = e.page_id WHERE depth < 25)", recursive=True))(
    lambda p, l: graph.reached(graph.edges_of(l, undirected=True), [start_page(l)], max_depth=25).select("page_id", "depth")
)
#: Starts of a sample, as many as the scheduler of statistics asks for.
STARTS = 200
_SOURCES = f"sources AS (SELECT page_id FROM (SELECT page_id FROM link GROUP BY 1) ORDER BY md5('0:' || page_id), page_id LIMIT {STARTS})"
_MULTI = """walk(source_id, page_id, depth) USING KEY (source_id, page_id) AS (SELECT page_id, page_id, 0 FROM sources
  UNION SELECT w.source_id, e.page_link, w.depth + 1 FROM walk w JOIN link e ON w.page_id = e.page_id ANTI JOIN recurring.walk r ON r.source_id = w.source_id AND r.page_id = e.page_link GROUP BY ALL),
reached AS (SELECT source_id, page_id, depth FROM walk),
hist AS (SELECT source_id, depth, count(*) AS n FROM reached WHERE depth > 0 GROUP BY ALL)"""
_AVERAGE = "average AS (SELECT depth, avg(n / (SELECT count(*) FROM page)::DOUBLE) AS mean, coalesce(stddev_samp(n / (SELECT count(*) FROM page)::DOUBLE), 0) AS std_dev FROM hist GROUP BY 1)"


def _starts(link: DataFrame) -> list[int]:
    return [r[0] for r in sampling.sample_pages(link.select("page_id").distinct(), STARTS).collect()]


def _summaries(link: DataFrame) -> DataFrame:
    """Breadth-first reach from a sample of sources."""
    return graph.summaries(graph.edges_of(link), _starts(link))


def _average(page: DataFrame, link: DataFrame) -> DataFrame:
    return sampling.average_histogram(graph.histograms(graph.edges_of(link), _starts(link)), page.count())


def rounded(rows: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return rows.withColumns({c: F.round(c, places) for c in columns})


on_graph("multi_bfs_hist", with_graph("SELECT * FROM hist", _SOURCES, _MULTI, recursive=True))(lambda p, l: graph.histograms(graph.edges_of(l), _starts(l)))
on_graph("reach_summary", with_graph("SELECT source_id, count(*) FILTER (depth > 0) AS num_visited, max(depth) AS eccentricity, CASE WHEN max(depth) > 0 THEN arg_min(page_id, (-depth, page_id)) END AS deepest FROM reached GROUP BY 1", _SOURCES, _MULTI, recursive=True))(lambda p, l: _summaries(l))
on_graph("avg_depth_histogram", with_graph("SELECT depth, round(mean, 8) AS mean, round(std_dev, 8) AS std_dev FROM average", _SOURCES, _MULTI, _AVERAGE, recursive=True))(lambda p, l: rounded(_average(p, l), "mean", "std_dev"))
on_graph("depth_cdf", with_graph("SELECT depth, round(sum(mean) OVER (ORDER BY depth), 8) AS cdf FROM average", _SOURCES, _MULTI, _AVERAGE, recursive=True))(lambda p, l: rounded(sampling.cumulative(_average(p, l)).select("depth", "cdf"), "cdf"))
on_graph("reach_p90", with_graph("SELECT depth FROM (SELECT depth, sum(mean) OVER (ORDER BY depth) AS cdf FROM average) WHERE cdf >= 0.35 ORDER BY depth LIMIT 1", _SOURCES, _MULTI, _AVERAGE, recursive=True))(lambda p, l: sampling.depth_for(sampling.cumulative(_average(p, l)), 0.35))
on_graph("max_min_avg", with_graph("""SELECT arg_min(source_id, (n, place)) AS min_key, min(n) AS min_value, arg_min(source_id, (-n, place)) AS max_key, max(n) AS max_value, round(avg(n), 8) AS avg, round(sum(n * pow(0.5, c - place + CASE WHEN place = 1 THEN 0 ELSE 1 END)), 8) AS avg_ref
FROM (SELECT source_id, n, row_number() OVER (ORDER BY source_id) AS place, count(*) OVER () AS c FROM (SELECT source_id, count(*) FILTER (depth > 0) AS n FROM reached GROUP BY 1))""", _SOURCES, _MULTI, recursive=True))(
    lambda p, l: rounded(sampling.max_min_avg(_summaries(l).select(F.col("source_id").alias("place"), F.col("source_id").alias("key"), F.col("num_visited").alias("value"))), "avg", "avg_ref")
)


def _far_pair(link: DataFrame) -> tuple[int, int]:
    start = start_page(link)
    row = graph.reached(graph.edges_of(link), [start], max_depth=6).orderBy(F.desc("depth"), "page_id").first()
    return start, row["page_id"]


def _path_total(link: DataFrame) -> DataFrame:
    """How many shortest paths there are, without writing one out."""
    start, end = _far_pair(link)
    found = graph.meet(graph.edges_of(link), start, end)
    counts = graph.path_counts(found.dag(), start, found.length())
    return counts.filter((F.col("page_id") == end) & (F.col("place") == found.length())).select(F.col("n_paths").cast("bigint").alias("n"))


_END = "goal AS (SELECT page_id, depth FROM tree WHERE depth <= 6 ORDER BY depth DESC, page_id LIMIT 1)"
_PATHS = """paths(path, page_id, depth) AS (SELECT [page_id]::BIGINT[], page_id, 0 FROM start UNION ALL
  SELECT list_append(path, t.page_id), t.page_id, t.depth FROM paths p JOIN link e ON e.page_id = p.page_id JOIN tree t ON t.page_id = e.page_link AND t.depth = p.depth + 1 WHERE p.depth < (SELECT depth FROM goal)),
shortest AS (SELECT path FROM paths WHERE page_id = (SELECT page_id FROM goal))"""
on_graph("shortest_paths_all", with_graph("SELECT list_aggregate(path, 'string_agg', ',') AS path FROM shortest", START_SQL, _BFS, _END, _PATHS, recursive=True))(
    lambda p, l: graph.shortest_paths(graph.edges_of(l), *_far_pair(l)).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))
)
on_graph("path_dag", with_graph("SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM shortest, range(1, 20) r(i) WHERE i < len(path)", START_SQL, _BFS, _END, _PATHS, recursive=True))(lambda p, l: graph.meet(graph.edges_of(l), *_far_pair(l)).dag().select("src", "dst"))
on_graph("path_total", with_graph("SELECT count(*) AS n FROM shortest", START_SQL, _BFS, _END, _PATHS, recursive=True))(lambda p, l: _path_total(l))
on_graph("path_nodes", with_graph("""SELECT page_id, depth, (SELECT count(DISTINCT path[depth + 2]) FROM shortest WHERE path[depth + 1] = n.page_id AND depth + 1 < len(path)) AS n_next,
  (SELECT count(*) FROM link e WHERE e.page_id = n.page_id) AS num_links, (SELECT count(*) FROM link e WHERE e.page_link = n.page_id) AS times_linked
FROM (SELECT path[i] AS page_id, min(i - 1)::INTEGER AS depth FROM shortest, range(1, 20) r(i) WHERE i <= len(path) GROUP BY 1) n""", START_SQL, _BFS, _END, _PATHS, recursive=True))(
    lambda p, l: graph.path_nodes(graph.shortest_paths(graph.edges_of(l), *_far_pair(l)), l)
)
on_graph("path_titles", with_graph("SELECT (SELECT string_agg(page_title, '|' ORDER BY i) FROM (SELECT unnest(path) AS page_id, generate_subscripts(path, 1) AS i) JOIN page USING (page_id)) AS titles FROM shortest", START_SQL, _BFS, _END, _PATHS, recursive=True))(
    lambda p, l: graph.path_titles(graph.shortest_paths(graph.edges_of(l), *_far_pair(l)), p).select(F.array_join("titles", "|").alias("titles"))
)
on_graph("incident_links", with_graph("SELECT page_id AS src, page_link AS dst FROM link WHERE page_id = (SELECT page_id FROM start) OR page_link = (SELECT page_id FROM start)", START_SQL))(lambda p, l: graph.incident(graph.edges_of(l), start_page(l)))
on_graph("links_inside_cluster", with_graph("SELECT page_id AS src, page_link AS dst FROM link WHERE page_id IN (SELECT page_id FROM page WHERE NOT is_redirect) AND page_link IN (SELECT page_id FROM page WHERE NOT is_redirect)"))(lambda p, l: graph.inside(graph.edges_of(l), p.filter("NOT is_redirect")))
on_graph("degree_range", with_graph("SELECT min(n) AS low, max(n) AS high FROM (SELECT count(*) AS n FROM link GROUP BY page_id)"))(lambda p, l: graph.attribute_range(l.groupBy("page_id").agg(F.count("*").alias("n")), "n"))
_WCC = """both_ways AS (SELECT page_id, page_link FROM link UNION SELECT page_link, page_id FROM link),
label(page_id, component) AS (SELECT DISTINCT page_id, page_id FROM both_ways UNION SELECT e.page_link, component FROM label l JOIN both_ways e ON l.page_id = e.page_id WHERE component < e.page_link),
wcc AS (SELECT page_id, min(component) AS component FROM label GROUP BY 1)"""
on_graph("wcc_labels", with_graph("SELECT * FROM wcc", _WCC, recursive=True))(lambda p, l: graph.components(graph.edges_of(l)))
on_graph("wcc_sizes", with_graph("SELECT component AS cluster, count(*) AS size, min(page_id) AS representative FROM wcc GROUP BY 1", _WCC, recursive=True))(lambda p, l: graph.cluster_sizes(graph.components(graph.edges_of(l))))
on_graph("wcc_pruned", with_graph("""SELECT component, size, list_sort(members)::VARCHAR AS members FROM (SELECT component, count(*) AS size, list(page_id) AS members, row_number() OVER (ORDER BY count(*) DESC, component) AS place
FROM wcc WHERE page_id NOT IN (SELECT page_id FROM page WHERE is_redirect) GROUP BY 1) WHERE place > 1 AND size > 1""", _WCC, recursive=True))(
    lambda p, l: graph.pruned_components(graph.components(graph.edges_of(l)), p).withColumn("members", F.concat(F.lit("["), F.array_join(F.transform("members", lambda x: x.cast("string")), ", "), F.lit("]")))
)
register("wcc_orders", """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
label(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION SELECT w.b, min(l.component) FROM label l JOIN both_ways w ON w.a = l.node JOIN recurring.label r ON r.node = w.b WHERE l.component < r.component GROUP BY w.b)
SELECT node AS page_id, component FROM label""")(lambda s, d: graph.components(orders_graph(s, d)))
on_graph("ego_graph", with_graph("""SELECT src, dst FROM first_step UNION SELECT src, dst FROM second_step""", START_SQL,
    "ranked AS (SELECT page_id AS src, page_link AS dst, row_number() OVER (PARTITION BY page_id ORDER BY t.n DESC, page_link) AS place FROM link JOIN (SELECT page_link, count(*) AS n FROM link GROUP BY 1) t USING (page_link))",
    "first_step AS (SELECT src, dst FROM ranked WHERE place <= 4 AND src = (SELECT page_id FROM start))",
    "second_step AS (SELECT src, dst FROM ranked WHERE place <= 4 AND src IN (SELECT dst FROM first_step) AND src <> (SELECT page_id FROM start))"))(lambda p, l: graph.ego(l, start_page(l), neighbours=4)[1])
on_graph("category_walk", with_graph("SELECT start_id, array_to_string(arg_max(path, len(path)), ',') AS path, bool_or(page_id = 1) AS found FROM walk GROUP BY 1",
    "up AS (SELECT page_id, min(page_link) AS parent FROM link WHERE page_link < page_id GROUP BY 1)",
    "walk(start_id, path, page_id) AS (SELECT page_id, [page_id]::BIGINT[], page_id FROM page UNION ALL SELECT start_id, list_append(path, parent), parent FROM walk JOIN up USING (page_id) WHERE page_id <> 1)", recursive=True))(
    lambda p, l: graph.walk_up(graph.edges_of(l).filter("dst < src"), p, 1).withColumn("path", F.array_join("path", ","))
)
on_graph("communities")(lambda p, l: communities.communities(graph.edges_of(l)))
on_graph("wcc_modularity", with_graph("""SELECT round(sum(inside) / sum(degree) - sum(degree * degree) / pow(sum(degree), 2), 9) AS modularity FROM (
  SELECT a.component, count(*)::DOUBLE AS degree, (count(*) FILTER (a.component = b.component))::DOUBLE AS inside FROM both_ways e JOIN wcc a ON a.page_id = e.page_id JOIN wcc b ON b.page_id = e.page_link GROUP BY 1)""", _WCC, recursive=True))(
    lambda p, l: rounded(communities.modularity(graph.edges_of(l), graph.components(graph.edges_of(l))), "modularity", places=9)
)
on_graph("wiki_modularity", with_graph("""SELECT round(sum(inside) / sum(degree) - sum(degree * degree) / pow(sum(degree), 2), 9) AS modularity FROM (
  SELECT a.wiki_name, count(*)::DOUBLE AS degree, (count(*) FILTER (a.wiki_name = b.wiki_name))::DOUBLE AS inside FROM both_ways e JOIN page a ON a.page_id = e.page_id JOIN page b ON b.page_id = e.page_link GROUP BY 1)""", "both_ways AS (SELECT page_id, page_link FROM link UNION SELECT page_link, page_id FROM link)"))(
    lambda p, l: rounded(communities.modularity(graph.edges_of(l), p.select("page_id", "wiki_name")), "modularity", places=9)
)
register("category_subgraph", """WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), busy AS (SELECT dst AS node FROM e GROUP BY 1 HAVING count(*) > 1)
SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT node FROM busy) AND dst IN (SELECT node FROM busy)""")(lambda s, d: graph.category_subgraph(table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()))

# Stored trees, the index of links, sweeps over sample sizes, search in a dump

_POPULAR = "sources AS (SELECT page_link AS page_id FROM link GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"
_TREE = """trees AS (SELECT t.source_id, t.page_id, t.depth, min(p.page_id) AS previous_id FROM reached t
  LEFT JOIN link e ON e.page_link = t.page_id AND t.depth > 0 LEFT JOIN reached p ON p.source_id = t.source_id AND p.page_id = e.page_id AND p.depth = t.depth - 1 GROUP BY ALL)"""


def _stored_trees(link: DataFrame) -> DataFrame:
    """Trees of the five most linked pages, stored by two runs of which the second finds some sources done."""
    spark, store = link.sparkSession, tables.fresh_path(link.sparkSession, "trees")
    popular = [r[0] for r in link.groupBy("page_link").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_link").limit(5).collect()]
    trees.precompute(graph.edges_of(link), popular[:2], store)
    trees.precompute(graph.edges_of(link), popular, store)
    return trees.read_trees(spark, store)


on_graph("tree_store", with_graph("SELECT source_id, page_id, depth::INTEGER AS depth, previous_id::DOUBLE AS previous_id FROM trees", _POPULAR, _MULTI, _TREE, recursive=True))(lambda p, l: as_doubles(_stored_trees(l), "previous_id"))
on_graph("tree_stats", with_graph("""SELECT wiki_name, s.page_id AS source_id, page_title, coalesce(num_visited, 0) AS num_visited, coalesce(hist, '') AS hist, coalesce(longest, '') AS longest
FROM sources s LEFT JOIN page USING (page_id) LEFT JOIN (SELECT source_id, count(*) FILTER (depth > 0) AS num_visited FROM trees GROUP BY 1) v ON v.source_id = s.page_id
LEFT JOIN (SELECT source_id, string_agg(depth || ':' || n, ',' ORDER BY depth) AS hist FROM hist GROUP BY 1) h ON h.source_id = s.page_id
LEFT JOIN (SELECT source_id, string_agg(page_title, '|' ORDER BY depth) AS longest FROM up LEFT JOIN page USING (page_id) WHERE depth > 0 GROUP BY 1) u ON u.source_id = s.page_id""", _POPULAR, _MULTI, _TREE,
    "up(source_id, page_id, depth, previous_id) AS (SELECT * FROM (SELECT DISTINCT ON (source_id) * FROM trees ORDER BY source_id, depth DESC, page_id) UNION ALL SELECT t.* FROM up JOIN trees t ON t.source_id = up.source_id AND t.page_id = up.previous_id)", recursive=True))(
    lambda p, l: _tree_stats(p, l)
)


def _tree_stats(page: DataFrame, link: DataFrame) -> DataFrame:
    """Statistics of the stored trees, upserted twice and read back, maps and lists as text."""
    spark, path = link.sparkSession, tables.fresh_path(link.sparkSession, "tree-stats")
    found = tables.cut(trees.tree_stats(_stored_trees(link), page))
    trees.upsert_stats(found, path)
    trees.upsert_stats(found.orderBy("source_id").limit(1), path)
    entries = F.transform(F.array_sort(F.map_entries("depth_histogram")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return trees.read_stats(spark, path).select("wiki_name", "source_id", "page_title", "num_visited", F.array_join(entries, ",").alias("hist"), F.array_join("longest_path", "|").alias("longest"))


_SIZES = [1, 5, 20, 100, 200]
on_graph("sample_sweep", with_graph("""SELECT size, depth, round(avg(n / (SELECT count(*) FROM page)::DOUBLE), 8) AS mean, count(*) AS n_samples
FROM hist JOIN (SELECT page_id, row_number() OVER (ORDER BY md5('0:' || page_id), page_id) AS place FROM sources) o ON o.page_id = source_id JOIN (SELECT unnest([1, 5, 20, 100, 200])::INTEGER AS size) ON place <= size GROUP BY 1, 2""", _SOURCES, _MULTI, recursive=True))(lambda p, l: _sweep(p, l))


def _sweep(page: DataFrame, link: DataFrame) -> DataFrame:
    starts = _starts(link)
    order = link.sparkSession.createDataFrame([(s, i + 1) for i, s in enumerate(starts)], "source_id bigint, place int")
    return rounded(sampling.sweep(graph.histograms(graph.edges_of(link), starts), order, _SIZES, page.count()), "mean")


def _link_index(link: DataFrame) -> index.LinkIndex:
    path = tables.fresh_path(link.sparkSession, "index")
    return index.build(link, "links_" + path[-32:], path, buckets=16)


on_graph("neighbours_indexed", ORACLE_SQL["neighbours_ranked"])(lambda p, l: index.neighbours(l.sparkSession, _link_index(l), p, start_page(l)))
on_graph("degrees_indexed", with_graph("SELECT n.page_id, (SELECT count(*) FROM link WHERE page_id = n.page_id) AS num_links, (SELECT count(*) FROM link WHERE page_link = n.page_id) AS times_linked FROM (SELECT DISTINCT page_link AS page_id FROM link WHERE page_id = (SELECT page_id FROM start)) n", START_SQL))(
    lambda p, l: _degrees_indexed(l)
)


def _degrees_indexed(link: DataFrame) -> DataFrame:
    """Degrees of the start page's neighbours, a page of links as the server shows it."""
    spark, found = link.sparkSession, _link_index(link)
    return index.degrees_of(spark, found, [r[0] for r in index.links_from(spark, found, start_page(link)).collect()])


on_graph("hot_links", with_graph("SELECT wiki_name, page_id, page_link FROM link WHERE page_id IN (SELECT page_id FROM link GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)"))(lambda p, l: index.hot_links(l, 50))
on_graph("links_of_keys", with_graph("SELECT page_link, list_sort(list(page_id))::VARCHAR AS neighbours FROM link WHERE page_link IN (SELECT page_id FROM page WHERE is_redirect) GROUP BY 1"))(
    lambda p, l: index.links_of_keys(l, p.filter("is_redirect").select("page_id"), incoming=True).withColumn("neighbours", F.concat(F.lit("["), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ", "), F.lit("]")))
)


def _raw_pagelinks(spark: SparkSession, d: str) -> DataFrame:
    """The orders as statements of a pagelinks dump, a thousand tuples or so each."""
    cell = F.format_string("(%d,%d,%d)", F.col("o_orderkey"), F.col("o_orderkey") % 3, F.col("o_custkey"))
    rows = table(spark, d, "orders").groupBy(F.expr("o_orderkey div 1000").alias("part")).agg(F.array_join(F.collect_list(cell), ",").alias("tuples"))
    return rows.select(F.concat(F.lit("INSERT INTO `pagelinks` VALUES "), "tuples").alias("value"))


register("dump_search", "SELECT o_orderkey AS pl_from, (o_orderkey % 3)::INTEGER AS pl_from_namespace, o_custkey AS pl_target_id FROM orders WHERE o_totalprice > 300000")(
    lambda s, d: search.links_of_pages(_raw_pagelinks(s, d), table(s, d, "orders").filter("o_totalprice > 300000").select("o_orderkey"))[0]
)

# Saved answers of the API, and validation against them

_ANSWER_ROWS = """numbered AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as titles that customers link to, saved in answers of four; of each seventh customer the second answer was not saved."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("title"), F.expr("cast((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) div 4 AS int)").alias("part"), F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    entries = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('{"ns":0,"title":"'), "title", F.lit('"}')))), ",")
    parts = rows.groupBy("o_custkey", "part").agg(entries.alias("entries"), F.first("n").alias("n"))
    more = F.when((F.col("part") + 1) * 4 < F.col("n"), F.concat(F.lit('"continue":{"plcontinue":"p'), (F.col("part") + 1).cast("string"), F.lit('"},'))).otherwise("")
    value = F.concat(F.lit("{"), more, F.lit('"query":{"pages":[{"pageid":'), F.col("o_custkey").cast("string"), F.lit(',"links":['), "entries", F.lit("]}]}}"))
    saved = parts.filter("NOT (o_custkey % 7 = 0 AND part = 1)")
    return saved.select(F.col("o_custkey").alias("request"), F.when(F.col("part") > 0, F.concat(F.lit("p"), F.col("part").cast("string"))).alias("token"), value.alias("value"))


register("api_links", f"WITH {_ANSWER_ROWS} SELECT o_custkey AS request, o_orderkey::VARCHAR AS title, NOT (o_custkey % 7 = 0 AND (SELECT count(*) FROM orders o WHERE o.o_custkey = n.o_custkey) > 4) AS complete FROM numbered n WHERE o_custkey % 7 <> 0 OR place <= 4")(
    lambda s, d: api.link_titles(_answers(s, d))
)


def _validation_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(stored, live, pages, evidence): orders as links, some missing on either side, with evidence for a part of them."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").cast("string").alias("title"), (F.col("o_orderkey") % 2 == 0).alias("outgoing"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"))
    stored, live = rows.filter("key % 11 <> 0"), rows.filter("key % 13 <> 0")
    evidence = rows.filter("key % 3 <> 0").select("page_id", "title", "outgoing", F.col("at").alias("added_at"), F.lit(None).cast("timestamp").alias("created_at"), F.col("at").alias("deleted_at"), (F.col("key") % 4 == 0).alias("in_old_revision"))
    return stored, live, rows.filter("page_id % 5 <> 0").select("page_id"), evidence


_VALIDATION = """rows AS (SELECT o_custkey AS page_id, o_orderkey::VARCHAR AS title, o_orderkey % 2 = 0 AS outgoing, o_orderkey AS key, o_orderdate AS day FROM orders WHERE o_custkey % 5 <> 0),
post AS (SELECT page_id, title, outgoing, CASE WHEN key % 11 = 0 THEN 'missing' ELSE 'outdated' END AS change FROM rows WHERE (key % 11 = 0) <> (key % 13 = 0)
  AND NOT (key % 3 <> 0 AND (day > TIMESTAMP '1996-01-01 00:00:00' OR (key % 11 = 0 AND key % 4 <> 0) OR (key % 13 = 0 AND key % 4 = 0))))"""
register("post_validation", f"WITH {_VALIDATION} SELECT * FROM post")(lambda s, d: (lambda t: validation.post_validation(*t, "19960101"))(_validation_tables(s, d)))
register("validation_gate", f"WITH {_VALIDATION} SELECT count(*) AS num_post, count(*) FILTER (NOT outgoing) AS num_new, count(*) FILTER (NOT outgoing) = 0 AS is_validated FROM post")(lambda s, d: _validation_gate(s, d))


def _validation_gate(spark: SparkSession, d: str) -> DataFrame:
    """The load's differences against those that the raw dump has already."""
    stored, live, sample, evidence = _validation_tables(spark, d)
    pre = validation.pre_validation(stored.filter("outgoing"), live, sample, evidence, "19960101", verify_recency=False)
    return validation.accepted(validation.post_validation(stored, live, sample, evidence, "19960101"), pre)


# History and sizes

register("trend_lag", f"""WITH {SNAPSHOT_SQL}, t AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY wiki_name, stat ORDER BY dump_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM snapshot)
SELECT wiki_name, stat, dump_date, value::DOUBLE AS value, before::DOUBLE AS before, (value - before)::DOUBLE AS change, round(CASE WHEN before = 0 THEN 0 * (value - before) ELSE (value - before) / before * 100 END, 6) AS percent,
  CASE WHEN value > before THEN 'up' WHEN value < before THEN 'down' WHEN value = before THEN 'no change' END AS direction FROM t""")(lambda s, d: as_doubles(history.trend(snapshots(s, d)).withColumn("percent", F.round("percent", 6)), "value", "before", "change"))
register("history_until", f"WITH {SNAPSHOT_SQL} SELECT wiki_name, stat, dump_date, value::DOUBLE AS value FROM snapshot WHERE dump_date <= 1997")(lambda s, d: as_doubles(history.until(snapshots(s, d), 1997), "value"))
register("snapshot_neighbours", f"WITH {SNAPSHOT_SQL} SELECT dump_date, (lag(dump_date) OVER w)::DOUBLE AS previous, (lead(dump_date) OVER w)::DOUBLE AS next FROM (SELECT DISTINCT dump_date FROM snapshot) WINDOW w AS (ORDER BY dump_date)")(lambda s, d: as_doubles(history.neighbours_in_time(snapshots(s, d)), "previous", "next"))
register("history_pivot", f"WITH {SNAPSHOT_SQL} SELECT stat, dump_date, (max(value) FILTER (wiki_name = '1-URGENT'))::DOUBLE AS \"1-URGENT\", (max(value) FILTER (wiki_name = '5-LOW'))::DOUBLE AS \"5-LOW\" FROM snapshot GROUP BY 1, 2")(lambda s, d: as_doubles(history.matrix(snapshots(s, d), ["1-URGENT", "5-LOW"]), "1-URGENT", "5-LOW"))
register("size_join", """WITH l AS (SELECT s_nationkey AS wiki_name, count(*) AS total_bytes FROM supplier GROUP BY 1), w AS (SELECT c_nationkey AS wiki_name, count(*) AS web_bytes FROM customer GROUP BY 1)
SELECT wiki_name, total_bytes, web_bytes::DOUBLE AS web_bytes FROM l LEFT JOIN w USING (wiki_name)""")(
    lambda s, d: as_doubles(history.size_table(table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("wiki_name")).agg(F.count("*").alias("total_bytes")), table(s, d, "customer").groupBy(F.col("c_nationkey").alias("wiki_name")).agg(F.count("*").alias("web_bytes"))), "web_bytes")
)
register("wiki_sizes", "SELECT p_brand AS wiki_name, sum(p_size)::BIGINT AS total_bytes, coalesce(sum(p_size) FILTER (p_type IN ('ECONOMY', 'STANDARD')), 0)::BIGINT AS selected_bytes FROM part GROUP BY 1")(lambda s, d: history.wiki_sizes(table(s, d, "part").select(F.col("p_brand").alias("wiki_name"), F.col("p_type").alias("table"), F.col("p_size").alias("bytes")), ["ECONOMY", "STANDARD"]))

# Sets, validation and scheduling

_OLD, _NEW = "(SELECT page_id, page_link FROM link WHERE (page_id + page_link) % 5 <> 0)", "(SELECT page_id, page_link FROM link WHERE (page_id + page_link) % 7 <> 0)"
_DIFF = f"diff AS (SELECT *, 'added' AS change FROM ({_NEW} EXCEPT {_OLD}) UNION ALL SELECT *, 'deleted' FROM ({_OLD} EXCEPT {_NEW}))"


def _versions(link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two dumps of the default graph that differ in some links."""
    mark = F.col("page_id") + F.col("page_link")
    return link.filter(mark % 5 != 0), link.filter(mark % 7 != 0)


on_graph("symmetric_diff", with_graph("SELECT * FROM diff", _DIFF))(lambda p, l: checks.difference(*_versions(l), ["page_id", "page_link"]))
on_graph("edge_diff", with_graph("SELECT count(*) FILTER (change = 'added') AS num_added, count(*) FILTER (change = 'deleted') AS num_deleted FROM diff", _DIFF))(lambda p, l: checks.difference_counts(*_versions(l), ["page_id", "page_link"]))
_FILES = "files AS (SELECT DISTINCT o_orderpriority AS wiki_name, o_custkey % 200 AS dump_date, o_orderstatus AS \"table\" FROM orders)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("wiki_name"), (F.col("o_custkey") % 200).alias("dump_date"), F.col("o_orderstatus").alias("table")).distinct()


register("complete_dumps", f"WITH {_FILES} SELECT wiki_name, dump_date FROM files WHERE \"table\" IN ('F', 'O', 'P') GROUP BY ALL HAVING count(*) = 3")(lambda s, d: checks.complete_dumps(_files(s, d), ["F", "O", "P"]))
register("dump_dates_common", f"WITH {_FILES} SELECT dump_date FROM files GROUP BY 1 HAVING count(DISTINCT wiki_name) = 5")(lambda s, d: checks.common_dates(_files(s, d), 5))
register("tasks_todo", f"WITH {_FILES} SELECT DISTINCT wiki_name, dump_date FROM files WHERE (wiki_name, dump_date) NOT IN (SELECT (wiki_name, dump_date) FROM files WHERE \"table\" = 'P')")(lambda s, d: checks.todo(_files(s, d), _files(s, d).filter("table = 'P'")))
register("tasks_enqueue", f"""WITH {_FILES}, todo AS (SELECT DISTINCT wiki_name, dump_date FROM files WHERE (wiki_name, dump_date) NOT IN (SELECT (wiki_name, dump_date) FROM files WHERE "table" = 'P'))
SELECT wiki_name, dump_date, CASE WHEN dump_date = (SELECT max(dump_date) FROM todo) THEN '1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW'
  ELSE (SELECT string_agg(u.wiki_name, ',' ORDER BY u.wiki_name) FROM todo u WHERE u.dump_date = t.dump_date) END AS required FROM todo t""")(
    lambda s, d: checks.enqueue(checks.todo(_files(s, d), _files(s, d).filter("table = 'P'")), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).withColumn("required", F.array_join("required", ","))
)
register("unprocessed_wikis", "SELECT DISTINCT o_orderpriority AS wiki_name, o_custkey % 200 AS dump_date FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_totalprice > 150000 AND p.o_orderpriority = o.o_orderpriority AND p.o_custkey % 200 = o.o_custkey % 200)")(
    lambda s, d: checks.unprocessed(table(s, d, "orders").select(F.col("o_orderpriority").alias("wiki_name"), (F.col("o_custkey") % 200).alias("dump_date"), F.when(F.col("o_orderstatus") == "O", "download").when(F.col("o_orderstatus") == "F", "store").alias("kind"), (F.col("o_totalprice") - 150000).alias("size")))
)
register("missing_blocks", f"WITH {SNAPSHOT_SQL} SELECT DISTINCT dump_date FROM snapshot WHERE value IS NULL")(lambda s, d: checks.without_block(snapshots(s, d), "value"))
register("wiki_lists_merged", f"WITH {_FILES} SELECT dump_date, string_agg(DISTINCT wiki_name, ',' ORDER BY wiki_name) AS wikis FROM files WHERE \"table\" IN ('F', 'O') GROUP BY 1")(
    lambda s, d: _files(s, d).filter("table IN ('F', 'O')").groupBy("dump_date").agg(*(F.collect_set(F.when(F.col("table") == t, F.col("wiki_name"))).alias(t) for t in "FO")).select("dump_date", F.array_join(F.sort_array(scalars.merge_lists(F.col("F"), F.col("O"))), ",").alias("wikis"))
)
register("task_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")(lambda s, d: checks.latest(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"))


@register(
    "dump_status",
    """WITH t AS (SELECT o_custkey % 50 AS dump_date, CASE WHEN o_orderkey % 41 = 0 THEN 'RUNNING' WHEN o_orderkey % 37 = 0 THEN 'FAILED' WHEN o_orderkey % 2 = 0 THEN 'DONE' ELSE 'QUEUED' END AS status, o_orderdate AS finished_at FROM orders)
SELECT dump_date, CASE WHEN bool_or(status = 'RUNNING') THEN 'RUNNING' WHEN bool_or(status = 'FAILED') THEN 'FAILED'
  WHEN bool_or(status = 'DONE' AND epoch(TIMESTAMP '1998-01-02 00:00:00') - epoch(finished_at) <= 86400) THEN 'DONE' ELSE 'SCHEDULED' END AS status FROM t GROUP BY 1""",
)
def dump_status(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(key % 41 == 0, "RUNNING").when(key % 37 == 0, "FAILED").when(key % 2 == 0, "DONE").otherwise("QUEUED")
    tasks = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("dump_date"), status.alias("status"), F.col("o_orderdate").alias("finished_at"))
    return checks.dump_status(tasks, "1998-01-02 00:00:00")


register("category_argmax", "WITH m AS (SELECT DISTINCT l_partkey AS page_id, l_suppkey::VARCHAR AS category FROM lineitem), z AS (SELECT category, count(*) AS size FROM m GROUP BY 1) SELECT page_id, arg_min(category, (-size, category)) AS category, max(size) AS size FROM m JOIN z USING (category) GROUP BY 1")(
    lambda s, d: checks.largest_category(table(s, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.col("l_suppkey").cast("string").alias("category")).distinct())
)
register("category_count_hist", "SELECT n, count(*) AS num_categories FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n")).groupBy("n").agg(F.count("*").alias("num_categories")))

# Functions and files

register("size_parse", """SELECT p_partkey, floor(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1000000 WHEN 3 THEN (p_size + 0.5) * 1000000000 END)::DOUBLE AS bytes FROM part""")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalars.parse_size(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, [" b", " KB", " MB", ".5 GB", "XB"])), (F.col("p_partkey") % 5 + 1).cast("int")))).cast("double").alias("bytes"))
)
register("utf_lengths", "SELECT doc_id, length(text) AS characters, strlen(text) AS bytes FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", scalars.length_characters(F.col("text")).cast("bigint").alias("characters"), scalars.length_bytes(F.col("text")).cast("bigint").alias("bytes")))
register("chunk_split", "SELECT p_partkey, chunk::INTEGER AS chunk, count(*)::INTEGER AS n, min(j)::INTEGER AS low, max(j)::INTEGER AS high FROM (SELECT p_partkey, j, ntile(4) OVER (PARTITION BY p_partkey ORDER BY j) AS chunk FROM part, LATERAL (SELECT unnest(range(1, p_size + 1)) AS j)) GROUP BY 1, 2")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.posexplode(scalars.chunks(F.sequence(F.lit(1), F.col("p_size").cast("int")), 4)).alias("i", "part")).filter(F.size("part") > 0).select("p_partkey", (F.col("i") + 1).alias("chunk"), F.size("part").alias("n"), F.array_min("part").alias("low"), F.array_max("part").alias("high"))
)
register("sample_window", "SELECT event_type, count(*) AS n FROM events WHERE hour(ts) >= 2 AND hour(ts) < 6 GROUP BY 1")(lambda s, d: table(s, d, "events").filter(scalars.within_hours(F.col("ts"), 2, 6)).groupBy("event_type").agg(F.count("*").alias("n")))
register("percentages", "SELECT p_partkey, round(p_size / nullif(p_size % 4, 0)::DOUBLE * 100, 2) AS share FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", scalars.percentage(F.col("p_size"), F.col("p_size") % 4).alias("share")))
register("node_sizes", "SELECT page_id, round(least(150, greatest(15, sqrt(5 * n))), 6) AS size FROM (SELECT l_partkey AS page_id, count(*) AS n FROM lineitem GROUP BY 1)")(lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("page_id")).agg(F.count("*").alias("n")).select("page_id", F.round(scalars.node_size(F.col("n")), 6).alias("size")))
register("html_links", "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages) GROUP BY ALL")(lambda s, d: table(s, d, "pages").select("page_id", F.explode(files.href_links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n")))
register("windowed_events", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda s, d: streams.windowed_counts(table(s, d, "events")))
