"""Communities of an undirected graph by modularity: local moving, refinement, contraction.

A graph is a table of arcs (src, dst, weight), both directions of every edge
and loops once with their doubled weight, 0 where there is none, so the weights
of a node's arcs sum to its degree and all weights to 2 m. Each level moves nodes
to the neighbouring community that gains most modularity, refines each community
into connected parts, and makes every part a node of the next level's graph. All
of it is joins and sums; a level's tables are written in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import cut, cut_counting, dealt, forget

#: A move has to gain more than this share of 2 m, so that rounding moves nothing.
LEAST_GAIN = 1e-12
#: Turns of a refinement.
REFINING = 3


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` as a join's side that is shuffled by its key, not broadcast: tables of nodes grow with the graph, and each turn has several."""
    return rows.hint("shuffle_hash")


def arcs_of(edges: DataFrame) -> DataFrame:
    """Arcs of the simple undirected graph under (src, dst): each pair once per direction, without loops."""
    rows = edges.filter("src <> dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    return rows.union(rows.select("dst", "src")).distinct().withColumn("weight", F.lit(1.0))


def label_propagation(edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """(page_id, community): every node takes the label most of its neighbours have, the smallest of equals.

    Its own label counts once, which settles two-sided swaps.
    """
    both = arcs_of(edges).select("src", "dst").persist()
    labels = both.select(F.col("src").alias("page_id")).distinct().withColumn("community", F.col("page_id"))
    for _ in range(rounds):
        votes = both.join(_dealt(labels), both["dst"] == labels["page_id"]).select(F.col("src").alias("page_id"), "community").union(labels)
        counted = votes.groupBy("page_id", "community").agg(F.count("*").alias("n"))
        labels = cut(counted.groupBy("page_id").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
    both.unpersist()
    return labels


def partition_terms(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, inside, degree): the weight of arcs within each community, and of all its arcs."""
    a, b = labels.toDF("src", "_a"), labels.toDF("dst", "_b")
    rows = arcs.join(_dealt(a), "src").join(_dealt(b), "dst")
    return rows.groupBy(F.col("_a").alias("community")).agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))


def modularity(edges: DataFrame, labels: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): of the partition ``labels`` (page_id, community) of the undirected graph; 0 without edges."""
    per = partition_terms(arcs_of(edges), labels.select("page_id", F.col(labels.columns[1]).alias("community")))
    found = per.agg(F.sum("inside").alias("inside"), F.sum("degree").alias("m"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return found.select(F.when(F.col("m") > 0, F.col("inside") / F.col("m") - resolution * F.col("squares") / (F.col("m") * F.col("m"))).otherwise(0.0).alias("modularity"))


def _weighed(arcs: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """(node, degree, target, size, own, loop, seed, gain): every community beside a node, its own too, and what it would gain by the node.

    Sums of communities travel with their nodes to the arcs' far ends, and the
    arc from a node to itself brings its own community, so arcs (dealt by dst)
    meet one table and move once. ``seed`` is that of the node, or of a target's only node.
    """
    sums = state.groupBy("community").agg(F.expr("sum(degree) AS total"), F.expr("count(*) AS size"))
    far = state.join(_dealt(sums), "community").selectExpr("node AS dst", "community AS target", "total", "size", "seed")
    near = arcs.join(_dealt(far), "dst").selectExpr("src AS node", "degree", "target", "total", "size", "src = dst AS own", "weight", "CASE WHEN src = dst OR size = 1 THEN seed END AS seed")
    links = near.repartition("node").groupBy("node", "degree", "target", "total", "size").agg(
        F.expr("max(own) AS own"), F.expr("sum(if(own, 0D, weight)) AS linked"), F.expr("sum(if(own, weight, 0D)) AS loop"), F.expr("max(seed) AS seed")
    )
    # what the community would gain without the node itself in it
    gain = f"linked - {resolution!r}D * degree * (total - if(own, degree, 0D)) / {total!r}D AS gain"
    return links.selectExpr("node", "degree", "target", "size", "own", "loop", "seed", gain)


def _share(total: float, resolution: float) -> str:
    """What a node adds to the modularity, from the row of ``_weighed`` of its own community."""
    return f"(gain + loop - {resolution!r}D * degree * degree / {total!r}D) / {total!r}D"


def _moved(arcs: DataFrame, state: DataFrame, total: float, resolution: float, *, refine: bool = False) -> tuple[DataFrame, int, float]:
    """(node, degree, community, seed) after half of the nodes, drawn by their seeds, moved to their best community; how many moved; the modularity before.

    Moves of one turn are made side by side; since only a drawn half moves, two
    nodes rarely swap for ever, and the caller keeps what raised the modularity.
    To ``refine``, only nodes that are alone move, and only into communities that
    lose nobody in this turn, so a community that begins as a node stays connected.
    Seeds are data and change by hashing, so every turn runs the same compiled code.
    """
    rows = _weighed(arcs, state, total, resolution)
    if refine:
        rows = rows.filter("own OR size > 1 OR pmod(seed, 2) = 1")
    mine = [F.expr(f"max(if(own, {c}, NULL)) AS {name}") for name, c in {"community": "target", "stay": "gain", "alone": "size = 1", "seed": "seed", "quality": _share(total, resolution)}.items()]
    each = rows.groupBy("node", "degree").agg(F.expr("max_by(struct(target, gain), struct(gain, -target)) AS best"), *mine)
    better = f"pmod(seed, 2) = 0 AND best.gain > stay + {LEAST_GAIN * total!r}D" + " AND alone" * refine
    fresh = each.selectExpr("node", "degree", f"if({better}, best.target, community) AS community", "xxhash64(seed) AS seed", f"{better} AS moved", "quality")
    done, seen = cut_counting(fresh, sums=("quality",), moved=F.col("moved"))
    return done.select("node", "degree", "community", "seed"), seen["moved"], seen["quality"]


def _quality(arcs: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    return _weighed(arcs, state, total, resolution).filter("own").agg(F.expr(f"sum({_share(total, resolution)})")).first()[0]


def _local_moves(arcs: DataFrame, state: DataFrame, total: float, resolution: float, turns: int) -> tuple[DataFrame, float]:
    """The best state seen in up to ``turns`` turns of moves, and its quality, which each turn finds for the state that it begins with."""
    best, best_quality, quiet = state, None, 0
    for _ in range(turns):
        after, moved, quality = _moved(arcs, state, total, resolution)
        if best_quality is None or quality > best_quality:
            best, best_quality = state, quality
        state, quiet = after, 0 if moved else quiet + 1
        # two turns in a row draw most nodes at least once
        if quiet == 2:
            break
    if not quiet and (quality := _quality(arcs, state, total, resolution)) > (best_quality or float("-inf")):
        best, best_quality = state, quality
    return best, best_quality


def _inside(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """The arcs whose ends are in one community."""
    a, b = state.select(F.col("node").alias("src"), F.col("community").alias("_a")), state.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    return arcs.join(_dealt(b), "dst").join(_dealt(a), "src").filter("_a = _b").select(*arcs.columns)


def _connected(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """(node, part): the connected parts of every community, named by their least node."""
    parts = components(_inside(arcs, state).filter("src <> dst")).withColumnRenamed("page_id", "node")
    return state.select("node").join(_dealt(parts), "node", "left").select("node", F.coalesce("component", "node").alias("part"))


def _with_degrees(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """Arcs (src, dst, weight) and the degree of their src, dealt by dst."""
    return dealt(arcs.join(_dealt(state.select(F.col("node").alias("src"), "degree")), "src").select("src", "dst", "weight", "degree"), "dst")


def _contracted(arcs: DataFrame, parts: DataFrame, state: DataFrame) -> DataFrame:
    """The arcs between the parts (node, part) of nodes, dealt by dst; ``state`` has the parts' degrees."""
    a = parts.join(_dealt(state.select(F.col("node").alias("part"), F.col("degree").alias("_degree"))), "part").select(F.col("node").alias("src"), F.col("part").alias("_a"), "_degree")
    b = parts.toDF("dst", "_b")
    ends = arcs.join(_dealt(b), "dst").join(_dealt(a), "src").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight", F.col("_degree").alias("degree"))
    n = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(ends.repartition(n, "dst").groupBy("src", "dst", "degree").agg(F.sum("weight").alias("weight")).select("src", "dst", "weight", "degree"), "dst", placed=True)


def communities(edges: DataFrame, *, resolution: float = 1.0, max_levels: int = 10, turns: int = 8) -> DataFrame:
    """(page_id, community) of every end of an edge that is no loop; a community is named by its least page.

    Every community is connected, and the modularity at ``resolution`` is at
    least that of each node on its own. Ties go to the smaller name, so equal
    graphs give equal partitions. An empty graph gives an empty table.
    """
    arcs = cut(arcs_of(edges))
    total = arcs.agg(F.sum("weight")).first()[0]
    if not total:
        return arcs.select(F.col("src").alias("page_id"), F.col("dst").alias("community"))
    state = cut(arcs.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")).withColumn("community", F.col("node")).withColumn("seed", F.xxhash64("node")))
    members = state.select(F.col("node").alias("page_id"), "node")
    loops = state.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))
    quality, graph = None, _with_degrees(arcs.union(loops), state)
    for _ in range(max_levels):
        state, reached_ = _local_moves(graph, state, total, resolution, turns)
        if quality is not None and reached_ <= quality + LEAST_GAIN:
            break
        quality = reached_
        # refinement: nodes start alone again and join only within their community
        within, refined = dealt(_inside(graph, state), "dst"), state.withColumn("community", F.col("node"))
        for _ in range(REFINING):
            refined, _, _ = _moved(within, refined, total, resolution, refine=True)
        forget(within)
        # parts become nodes and begin in the community that they were refined in
        parts = refined.select("node", F.col("community").alias("part"))
        members = cut(members.join(_dealt(parts), "node").select("page_id", F.col("part").alias("node")))
        held = refined.withColumnRenamed("community", "part").join(_dealt(state.select("node", "community")), "node")
        state = cut(held.groupBy(F.col("part").alias("node")).agg(F.sum("degree").alias("degree"), F.min("community").alias("community"), F.max("seed").alias("seed")))
        finer, graph = graph, _contracted(graph, parts, state)
        forget(finer)
    # a community that moves left in pieces falls apart, which never lowers the modularity; nodes are connected, so their own arcs tell
    final = cut(members.join(_dealt(_connected(graph, state)), "node").select("page_id", "part"))
    forget(graph)
    names = final.groupBy("part").agg(F.min("page_id").alias("community"))
    return final.join(_dealt(names), "part").select("page_id", "community")
