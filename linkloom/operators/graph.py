"""Traversals of the link graph: breadth-first reach, shortest paths, components.

Edges are (src, dst). Every traversal advances level by level as joins of
DataFrames whose state is checkpointed in the shared folder; the driver sees
counts of rows only, and the one path or pair that a caller asks for.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .serve import of_dump
from .tables import cut, cut_counting, dealt, dealt_counting, drop, forget

#: Sources that share one bitmask; the sign bit stays free.
LANE = 63
#: Lanes that are columns of one table; further sources are searched for in a further pass.
WIDE = 8


def edges_of(link: DataFrame, *, undirected: bool = False, **dump: str | None) -> DataFrame:
    """(src, dst) of links, of one wiki (wiki_name) and dump (dump_date) where these are named."""
    rows = of_dump(link, **dump).select(F.col("page_id").alias("src"), F.col("page_link").alias("dst"))
    return rows.union(rows.select("dst", "src")).distinct() if undirected else rows


def _long(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))


def levels(edges: DataFrame, sources: list[int], *, max_depth: int | None = None) -> DataFrame:
    """(page_id, lane, depth, fresh): which sources reach a page for the first time at which depth.

    Sources are numbered in the given order; bit i of ``fresh`` in lane l is
    source 63 l + i. The sources of WIDE lanes share each scan of the edges: a
    level is one join and one bitwise sum for all of them.
    """
    spark = edges.sparkSession
    near, parts = dealt(_long(edges), "src"), []
    for first in range(0, len(sources), LANE * WIDE):
        found = _wide_levels(near, [int(s) for s in sources[first : first + LANE * WIDE]], max_depth)
        lanes = [F.struct(F.lit(first // LANE + i).alias("lane"), F.col(c).alias("fresh")) for i, c in enumerate(found.columns[2:])]
        parts.append(found.select("page_id", "depth", F.explode(F.array(*lanes)).alias("l")).select("page_id", "l.lane", "depth", "l.fresh").filter("fresh != 0"))
    forget(near)
    return functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "page_id bigint, lane int, depth int, fresh bigint")


def _wide_levels(near: DataFrame, sources: list[int], max_depth: int | None) -> DataFrame:
    """(page_id, depth, fresh0, fresh1, ...): the pages that a source reaches first at a depth, with one column of bits for each lane.

    Edges (dealt by src) and pages reached so far lie by page, so a level moves
    only the bits that the last one's pages hand on, summed before they move.
    Pages that are fresh have a folder of their own in each level's table: the
    next level reads them alone, and together they are the result.
    """
    spark, lanes = near.sparkSession, range(-(-len(sources) // LANE))
    seen, fresh, got = ([f"{name}{i}" for i in lanes] for name in ("seen", "fresh", "got"))
    zero = F.lit(0).cast("bigint")
    start = [(s, *((1 << n % LANE) if n // LANE == i else 0 for i in lanes)) for n, s in enumerate(sources)]
    rows = spark.createDataFrame(start, ", ".join(["page_id bigint", *(f"{c} bigint" for c in fresh)])).groupBy("page_id").agg(*(F.bit_or(c).alias(c) for c in fresh))
    state, depth = dealt(rows.select("page_id", F.lit(0).alias("depth"), *(F.col(f).alias(s) for f, s in zip(fresh, seen, strict=True)), *fresh, F.lit(True).alias("hot")), "page_id", parts="hot"), 0
    paths = [f"{state.cut_at}/hot=true"]
    while max_depth is None or depth < max_depth:
        depth += 1
        # neither side moves, so a hash table for each bucket takes the place of a broadcast
        step = near.join(state.filter("hot").select("page_id", *fresh).hint("shuffle_hash"), F.col("src") == F.col("page_id"))
        handed = step.groupBy(F.col("dst").alias("_page")).agg(*(F.bit_or(f).alias(g) for f, g in zip(fresh, got, strict=True)))
        both = state.select("page_id", *seen).join(handed.hint("shuffle_hash"), F.col("page_id") == F.col("_page"), "full_outer")
        old, new = ([F.coalesce(c, zero) for c in columns] for columns in (seen, got))
        now = both.select(
            F.coalesce("page_id", "_page").alias("page_id"), F.lit(depth).alias("depth"),
            *(o.bitwiseOR(n).alias(c) for o, n, c in zip(old, new, seen, strict=True)), *(n.bitwiseAND(F.bitwise_not(o)).alias(c) for o, n, c in zip(old, new, fresh, strict=True)),
        )
        hot = functools.reduce(Column.__or__, (F.col(c) != 0 for c in fresh))
        after, counted = dealt_counting(now.withColumn("hot", hot), "page_id", parts="hot", placed=True, fresh=F.col("hot"))
        forget(state, part="hot=false")
        state = after
        if not counted["fresh"]:
            break
        paths.append(f"{state.cut_at}/hot=true")
    forget(state, part="hot=false")
    return spark.read.schema(", ".join(["page_id bigint", "depth int", *(f"{c} bigint" for c in fresh)])).parquet(*paths)


def _each_source(rows: DataFrame, sources: list[int], bits: str = "fresh") -> DataFrame:
    """``rows`` once for every source whose bit is set, as source_id instead of lane and bits."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(LANE - 1)), lambda i: F.getbit(F.col(bits), i) == 1)
    names = F.array(*(F.lit(int(s)).cast("bigint") for s in sources))
    kept = [c for c in rows.columns if c not in ("lane", bits)]
    return rows.select(*kept, "lane", F.explode(numbers).alias("_bit")).select(F.get(names, F.col("lane") * LANE + F.col("_bit")).alias("source_id"), *kept)


def reached(edges: DataFrame, sources: list[int], *, max_depth: int | None = None) -> DataFrame:
    """(source_id, page_id, depth) of all nodes reached from each source; the source itself has depth 0."""
    return _each_source(levels(edges, sources, max_depth=max_depth), sources)


def bfs(edges: DataFrame, sources: list[int], *, max_depth: int | None = None) -> DataFrame:
    """(source_id, page_id, depth, previous_id) of all nodes reached from each source.

    The source has depth 0 and no previous node; of equally near parents the
    smallest counts. Parents are found by one more join over the edges, once
    all depths are known.
    """
    spark = edges.sparkSession
    found = cut(levels(edges, sources, max_depth=max_depth))
    above = found.select(F.col("page_id").alias("src"), "lane", (F.col("depth") + 1).alias("depth"), F.col("fresh").alias("_above"))
    below = found.select(F.col("page_id").alias("dst"), "lane", "depth", F.col("fresh").alias("_below"))
    shared = F.col("_above").bitwiseAND(F.col("_below"))
    steps = _long(edges).join(above, "src").join(below, ["dst", "lane", "depth"]).select("src", "dst", "lane", "depth", shared.alias("shared")).filter("shared != 0")
    tree = _each_source(steps, sources, "shared").groupBy("source_id", F.col("dst").alias("page_id"), "depth").agg(F.min("src").alias("previous_id"))
    roots = spark.createDataFrame([(int(s), int(s), 0, None) for s in dict.fromkeys(sources)], "source_id bigint, page_id bigint, depth int, previous_id bigint")
    return roots.union(tree.select("source_id", "page_id", "depth", "previous_id"))


def histograms(edges: DataFrame, sources: list[int], *, max_depth: int | None = None) -> DataFrame:
    """(source_id, depth, n): nodes first reached at each depth from 1 on, counted from the bitmasks without naming a node."""
    return _counted(levels(edges, sources, max_depth=max_depth).filter("depth > 0"), sources).select("source_id", "depth", "n")


def _counted(found: DataFrame, sources: list[int]) -> DataFrame:
    """(source_id, lane, bit, depth, n) of levels: how many nodes have a source's bit at a depth."""
    bits = [F.sum(F.getbit("fresh", F.lit(i)).cast("bigint")) for i in range(LANE)]
    counted = found.groupBy("lane", "depth").agg(F.array(*bits).alias("counts"))
    names = F.array(*(F.lit(int(s)).cast("bigint") for s in sources))
    each = counted.select("lane", "depth", F.posexplode("counts").alias("bit", "n")).filter("n > 0")
    return each.select(F.get(names, F.col("lane") * LANE + F.col("bit")).alias("source_id"), "lane", "bit", "depth", "n")


def summaries(edges: DataFrame, sources: list[int], *, max_depth: int | None = None) -> DataFrame:
    """``reach`` of each source, from the bitmasks: only the nodes at a source's greatest depth are ever named."""
    sources = list(dict.fromkeys(sources))
    found = levels(edges, sources, max_depth=max_depth)
    counted = _counted(found, sources)
    per = cut(counted.groupBy("source_id", "lane", "bit").agg(F.coalesce(F.sum(F.when(F.col("depth") > 0, F.col("n"))), F.lit(0)).cast("bigint").alias("num_visited"), F.max("depth").alias("eccentricity")))
    last = per.groupBy("lane", F.col("eccentricity").alias("depth")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("last"))
    ends = found.join(F.broadcast(last), ["lane", "depth"]).select("page_id", "lane", F.col("fresh").bitwiseAND(F.col("last")).alias("ends")).filter("ends != 0")
    deepest = _each_source(ends, sources, "ends").groupBy("source_id").agg(F.min("page_id").alias("deepest"))
    return per.join(deepest, "source_id").select("source_id", "num_visited", "eccentricity", F.when(F.col("num_visited") > 0, F.col("deepest")).alias("deepest"))


def histogram(reached: DataFrame) -> DataFrame:
    """Nodes first reached at each depth from 1 on, per source."""
    return reached.filter("depth > 0").groupBy("source_id", "depth").agg(F.count("*").alias("n"))


def reach(reached: DataFrame) -> DataFrame:
    """Per source: num_visited (without it), eccentricity, and the smallest deepest node."""
    per = reached.groupBy("source_id").agg(F.count_if(F.col("depth") > 0).alias("num_visited"), F.max("depth").alias("eccentricity"), F.min_by("page_id", F.struct(-F.col("depth"), F.col("page_id"))).alias("deepest"))
    return per.withColumn("deepest", F.when(F.col("num_visited") > 0, F.col("deepest")))


def path_to(tree: DataFrame, source: int, target: int) -> list[int]:
    """The path of a stored tree from source to target, one lookup a step; an unreached target is alone on it."""
    rows, path = tree.filter(F.col("source_id") == source).select("page_id", "previous_id"), [target]
    while (row := rows.filter(F.col("page_id") == path[-1]).select("previous_id").first()) and row[0] is not None:
        path.append(row[0])
    return path[::-1]


class Meeting:
    """A bidirectional search: the levels of both sides, and where they met."""

    def __init__(self, edges: DataFrame, start: int, end: int):
        self.edges, self.start, self.end = _long(edges).persist(), int(start), int(end)
        spark = edges.sparkSession
        self.sides = {back: [cut(spark.createDataFrame([(node,)], "page_id bigint"))] for back, node in ((False, self.start), (True, self.end))}
        self.met: DataFrame | None = self.sides[False][0] if self.start == self.end else None
        self.visited = 0

    def _ends(self, back: bool) -> tuple[Column, Column]:
        return (F.col("dst"), F.col("src")) if back else (F.col("src"), F.col("dst"))

    def progress(self) -> Iterator[dict]:
        """A record {visited} for each level, until the sides meet or one of them ends.

        Each round expands the side whose frontier has strictly fewer edges
        (the backward one if equal).
        """
        pending: dict[bool, int | None] = {False: None, True: None}
        size = {False: 1, True: 1}
        while self.met is None and size[False] and size[True]:
            for back in self.sides:
                if pending[back] is None:
                    near, _ = self._ends(back)
                    pending[back] = self.edges.join(self.sides[back][-1], near == F.col("page_id"), "left_semi").count()
            back = not pending[False] < pending[True]
            near, far = self._ends(back)
            frontier, known = self.sides[back][-1], functools.reduce(DataFrame.union, self.sides[back])
            other = self.sides[not back][-1].withColumn("_met", F.lit(True))
            step = self.edges.join(frontier, near == F.col("page_id"), "left_semi").select(far.alias("page_id")).distinct().join(known, "page_id", "left_anti")
            fresh, counted = cut_counting(step.join(other, "page_id", "left"), n=F.lit(True), met=F.col("_met"))
            self.sides[back].append(fresh.select("page_id"))
            self.visited += size[back]
            size[back], pending[back] = counted["n"], None
            if counted["met"]:
                self.met = fresh.filter("_met").select("page_id")
            yield {"visited": self.visited}

    def dag(self) -> DataFrame:
        """(src, dst, place): the edges of all shortest paths, with the number of steps before them; none if the sides never met."""
        parts = [self.edges.select("src", "dst", F.lit(0).alias("place")).limit(0)]
        if self.met is not None:
            length = len(self.sides[False]) - 1
            for back in self.sides:
                near, far = self._ends(back)
                reached_ = self.met
                for i in range(len(self.sides[back]) - 2, -1, -1):
                    place = length + len(self.sides[True]) - 2 - i if back else i
                    step = self.edges.join(self.sides[back][i], near == F.col("page_id"), "left_semi").join(reached_, far == F.col("page_id"), "left_semi")
                    parts.append(cut(step.select("src", "dst", F.lit(place).alias("place"))))
                    reached_ = parts[-1].select(near.alias("page_id")).distinct()
        return functools.reduce(DataFrame.union, parts).distinct()

    def length(self) -> int | None:
        """Steps of a shortest path, None if there is none."""
        return None if self.met is None else len(self.sides[False]) + len(self.sides[True]) - 2


def meet(edges: DataFrame, start: int, end: int) -> Meeting:
    """A finished bidirectional search."""
    found = Meeting(edges, start, end)
    for _ in found.progress():
        pass
    return found


def path_counts(dag: DataFrame, start: int, length: int) -> DataFrame:
    """(page_id, place, n_paths): how many shortest paths lead from the start to each node, summed over the DAG level by level."""
    now = dag.sparkSession.createDataFrame([(int(start),)], "page_id bigint").withColumn("n_paths", F.lit(1).cast("decimal(38,0)"))
    parts = [now.select("page_id", F.lit(0).alias("place"), "n_paths")]
    for place in range(length):
        step = dag.filter(F.col("place") == place).join(now, F.col("src") == F.col("page_id"))
        now = cut(step.groupBy(F.col("dst").alias("page_id")).agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths")))
        parts.append(now.select("page_id", F.lit(place + 1).alias("place"), "n_paths"))
    return functools.reduce(DataFrame.union, parts)


def enumerate_paths(dag: DataFrame, start: int, length: int) -> DataFrame:
    """All paths of a DAG as arrays of ids (column path), extended by one join a level."""
    paths = dag.sparkSession.createDataFrame([([int(start)],)], "path array<bigint>")
    for place in range(length):
        step = dag.filter(F.col("place") == place)
        paths = paths.join(step, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"))
    return paths


def shortest_paths(edges: DataFrame, start: int, end: int, *, max_paths: int | None = None) -> DataFrame:
    """All shortest paths as arrays of ids (column path); [start] if both are the same, no row if there is none.

    Two searches meet in the middle; what lies on a shortest path is a DAG over
    which paths are counted before any of them is written out, so that more
    than ``max_paths`` of them are refused in time. None sets no bound.
    """
    found = meet(edges, start, end)
    dag, length = found.dag(), found.length()
    if length is None:
        return edges.sparkSession.createDataFrame([], "path array<bigint>")
    dag = cut(dag)
    if max_paths is not None and path_total(dag, start, end, length) > max_paths:
        raise ValueError(f"more than {max_paths} shortest paths")
    return enumerate_paths(dag, start, length)


def path_total(dag: DataFrame, start: int, end: int, length: int) -> int:
    """The number of shortest paths from start to end."""
    row = path_counts(dag, start, length).filter((F.col("page_id") == int(end)) & (F.col("place") == length)).select("n_paths").first()
    return int(row[0]) if row else 0


def shortest_path_stream(edges: DataFrame, start: int, end: int, *, page: DataFrame | None = None, max_paths: int = 10_000) -> Iterator[dict]:
    """Progress records {visited} of a bidirectional search, one a level, as they come; the last also has paths.

    With ``page`` the last record has titles as well. At most ``max_paths``
    paths, counted before they are written out, come to the driver.
    """
    search = Meeting(edges, start, end)
    yield from search.progress()
    paths: list[list[int]] = []
    last: dict = {"visited": search.visited}
    if (length := search.length()) is not None:
        dag = cut(search.dag())
        if path_total(dag, start, end, length) > max_paths:
            raise ValueError(f"more than {max_paths} shortest paths")
        rows = enumerate_paths(dag, start, length)
        if page is None:
            paths = sorted(r["path"] for r in rows.collect())
        else:
            both = sorted((r["path"], r["titles"]) for r in path_titles(rows, page).collect())
            paths, last["titles"] = [p for p, _ in both], [t for _, t in both]
    elif page is not None:
        last["titles"] = []
    yield last | {"paths": paths}


def bfs_stream(edges: DataFrame, start: int, end: int, *, page: DataFrame | None = None, max_depth: int | None = None) -> Iterator[dict]:
    """Progress records {visited, depth} of a one-sided search, one a level; the last also has the path (ids, or titles with ``page``)."""
    rows = _long(edges).persist()
    spark = edges.sparkSession
    tree = [cut(spark.createDataFrame([(int(start), None)], "page_id bigint, previous_id bigint"))]
    visited, depth, size, hit = 1, 0, 1, int(start) == int(end)
    while size and not hit and (max_depth is None or depth < max_depth):
        depth += 1
        known = functools.reduce(DataFrame.union, tree).select("page_id")
        step = rows.join(tree[-1].select("page_id"), F.col("src") == F.col("page_id")).groupBy(F.col("dst").alias("page_id")).agg(F.min("src").alias("previous_id")).join(known, "page_id", "left_anti")
        fresh, counted = cut_counting(step, n=F.lit(True), hit=F.col("page_id") == int(end))
        size, hit = counted["n"], bool(counted["hit"])
        tree.append(fresh)
        visited += size
        yield {"visited": visited, "depth": depth}
    path = [int(end)] if hit else []
    for level in range(len(tree) - 1, 0, -1) if hit else ():
        path.append(tree[level].filter(F.col("page_id") == path[-1]).select("previous_id").first()[0])
    path.reverse()
    record: dict = {"visited": visited, "depth": depth, "path": path}
    if page is not None:
        titles = {r[0]: r[1] for r in page.filter(F.col("page_id").isin(path)).select("page_id", "page_title").collect()}
        record["titles"] = [titles.get(p) for p in path]
    rows.unpersist()
    yield record


def ndjson(records: Iterator[dict]) -> Iterator[str]:
    """Each record as one line of JSON, as soon as it comes."""
    for record in records:
        yield json.dumps(record, ensure_ascii=False) + "\n"


def path_titles(paths: DataFrame, page: DataFrame) -> DataFrame:
    """Paths, which differ from each other, with the titles (titles) of their pages; an unknown page has a null there."""
    places = paths.select("path", F.posexplode("path").alias("place", "page_id"))
    titled = places.join(page.select("page_id", "page_title"), "page_id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("place", "page_title")))
    return titled.groupBy("path").agg(F.transform(ordered, lambda x: x["page_title"]).alias("titles"))


def incident(edges: DataFrame, node: int) -> DataFrame:
    """Edges that begin or end at ``node``."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``members`` (page_id)."""
    ids = members.select("page_id").distinct()
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")


def cluster_sizes(labels: DataFrame, by: str = "component") -> DataFrame:
    """(cluster, size, representative) of every cluster; its smallest page represents it."""
    return labels.groupBy(F.col(by).alias("cluster")).agg(F.count("*").alias("size"), F.min("page_id").alias("representative"))


def attribute_range(nodes: DataFrame, attribute: str) -> DataFrame:
    """The least and the greatest value (low, high) of an attribute of nodes."""
    return nodes.agg(F.min(attribute).alias("low"), F.max(attribute).alias("high"))


def path_edges(paths: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) of all paths."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.filter(F.size("path") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct()


def path_nodes(paths: DataFrame, link: DataFrame) -> DataFrame:
    """Nodes of all paths: first position, out-degree among the paths, num_links and times_linked."""
    first = paths.select(F.posexplode("path").alias("depth", "page_id")).groupBy("page_id").agg(F.min("depth").alias("depth"))
    inside = path_edges(paths).groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("n_next"))
    nodes = first.join(inside, "page_id", "left")
    for by, name in (("page_id", "num_links"), ("page_link", "times_linked")):
        own = link.select(F.col(by).alias("page_id")).join(first.select("page_id"), "page_id", "left_semi")
        nodes = nodes.join(own.groupBy("page_id").agg(F.count("*").alias(name)), "page_id", "left")
    return nodes.select("page_id", "depth", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_next", "num_links", "times_linked")))


def components(edges: DataFrame) -> DataFrame:
    """(page_id, component) for every end of an edge: the smallest node weakly connected to it.

    Alternating large and small stars: a round links the larger neighbours of a
    node, then its smaller ones, to the least node around it. Minima are
    aggregated before they are joined back, so a hub gathers no list. It is
    over when the links are stars: every child has one parent, and no parent
    is a child. Pairs lie by their first node, in both directions before a
    round, so each half of a round moves them once and all else is done in place.
    """
    rows = _long(edges)

    def by_first(pairs: DataFrame) -> DataFrame:
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return dealt(pairs.repartition(n, "u").distinct(), "u", placed=True)

    def around(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def mirrored(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select("v", "u")).toDF("u", "v")

    def done_with(pairs: DataFrame) -> None:
        forget(pairs)
        drop(pairs)

    now = by_first(mirrored(rows.filter("src <> dst").toDF("u", "v")))
    while not now.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("parents"), F.max("v").alias("most")).filter("parents > 1 OR (parents = 1 AND most > u)").isEmpty():
        large = by_first(now.join(around(now).hint("shuffle_hash"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        done_with(now)
        least = around(large)
        small = large.join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = by_first(mirrored(small.filter("u <> v")))
        done_with(large)
    labels = cut(around(now).toDF("page_id", "component"))
    done_with(now)
    # ends of loops alone
    loops = cut(rows.filter("src = dst").select(F.col("src").alias("page_id")).distinct())
    if loops.isEmpty():
        return labels
    return labels.union(loops.join(labels, "page_id", "left_anti").select("page_id", F.col("page_id").alias("component")))


def pruned_components(labels: DataFrame, page: DataFrame) -> DataFrame:
    """Components without redirects, singletons and the largest: (component, size, members)."""
    kept = labels.join(page.filter("is_redirect").select("page_id"), "page_id", "left_anti")
    groups = kept.groupBy("component").agg(F.count("*").alias("size"))
    largest = groups.orderBy(F.desc("size"), "component").limit(1).select("component")
    small = groups.filter("size > 1").join(largest, "component", "left_anti")
    return kept.join(small, "component").groupBy("component", "size").agg(F.sort_array(F.collect_list("page_id")).alias("members"))


def ego(link: DataFrame, start: int, *, depth: int = 2, neighbours: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes (page_id, depth), edges) around a page: each page's ``neighbours`` most linked links, ``depth`` steps."""
    spark = link.sparkSession
    times = link.groupBy(F.col("page_link").alias("dst")).agg(F.count("*").alias("times_linked"))
    nodes = spark.createDataFrame([(start, 0)], "page_id bigint, depth int")
    frontier, edges = nodes, None
    for level in range(1, depth + 1):
        rows = link.join(frontier.select("page_id"), "page_id", "left_semi").select(F.col("page_id").alias("src"), F.col("page_link").alias("dst")).join(times, "dst")
        order = Window.partitionBy("src").orderBy(F.desc("times_linked"), "dst")
        step = cut(rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= neighbours).select("src", "dst"))
        edges = step if edges is None else edges.union(step).distinct()
        frontier = cut(step.select(F.col("dst").alias("page_id")).distinct().join(nodes.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(level)))
        nodes = nodes.union(frontier)
    return nodes, edges


def walk_up(edges: DataFrame, starts: DataFrame, root: int) -> DataFrame:
    """(start_id, path, found): the way from every start (page_id) to ``root`` along edges from a child (src) to its parents (dst).

    Each step takes the smallest parent that is not on the path yet; a walk
    that has none left ends without the root. All starts advance together, one
    join a step, and those that ended leave the join.
    """
    parents = cut(edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("parents")))
    open_walks = starts.select(F.col("page_id").alias("start_id"), F.array(F.col("page_id").cast("bigint")).alias("path")).distinct()
    ended = []
    while True:
        last = F.element_at("path", -1)
        at_root = open_walks.select("start_id", "path", (last == root).alias("found"), last.alias("src"))
        fresh = at_root.join(parents, "src", "left").withColumn("next", F.when(~F.col("found"), F.get(F.array_except("parents", "path"), F.lit(0))))
        step = cut(fresh.select("start_id", "path", "found", "next"))
        ended.append(step.filter("next IS NULL").select("start_id", "path", "found"))
        open_walks = step.filter("next IS NOT NULL").select("start_id", F.concat("path", F.array(F.col("next").cast("bigint"))).alias("path"))
        if open_walks.isEmpty():
            return functools.reduce(DataFrame.union, ended)


def category_subgraph(edges: DataFrame) -> DataFrame:
    """Category edges both of whose ends have more than one sub-category, without loops."""
    busy = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("node")
    rows = edges.filter("src <> dst")
    return rows.join(busy.withColumnRenamed("node", "src"), "src", "left_semi").join(busy.withColumnRenamed("node", "dst"), "dst", "left_semi")
