"""Traversals and communities over Spark against brute force on random graphs."""

import collections
import json
import random

import pytest

from linkloom.operators import communities, graph, tables


def random_edges(seed, nodes, n):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)})


def table(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint")


def depths_from(edges, start):
    near = collections.defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    depth, queue = {start: 0}, collections.deque([start])
    while queue:
        node = queue.popleft()
        for other in near[node]:
            if other not in depth:
                depth[other] = depth[node] + 1
                queue.append(other)
    return depth


def test_many_sources_share_scans(spark):
    """More sources than one bitmask holds, one of them twice and one unknown to the graph."""
    edges = random_edges(1, 90, 270)
    sources = [*range(70), 5, 1000]
    found = collections.defaultdict(dict)
    for r in graph.bfs(table(spark, edges), sources).collect():
        found[r["source_id"]][r["page_id"]] = (r["depth"], r["previous_id"])
    counts = {(r["source_id"], r["depth"]): r["n"] for r in graph.histograms(table(spark, edges), sources[:70]).collect()}
    expected_counts = collections.Counter()
    for source in set(sources):
        depth = depths_from(edges, source)
        expected = {n: (d, min((a for a, b in edges if b == n and depth.get(a) == d - 1), default=None) if d else None) for n, d in depth.items()}
        assert found[source] == expected
        expected_counts.update((source, d) for d in depth.values() if d and source < 70)
    assert counts == expected_counts
    assert graph.reached(table(spark, edges), [3], max_depth=1).count() == 1 + len({b for a, b in edges if a == 3 and b != 3})
    assert graph.levels(table(spark, edges), []).count() == 0


def all_shortest(edges, start, end):
    if start == end:
        return [[start]]
    depth = depths_from(edges, start)
    if end not in depth:
        return []
    paths = [[end]]
    for d in range(depth[end] - 1, -1, -1):
        paths = [[a, *p] for p in paths for a, b in edges if b == p[0] and depth.get(a) == d]
    return sorted(paths)


def test_paths_against_brute_force(spark):
    edges = random_edges(2, 40, 110)
    rows = table(spark, edges)
    for start, end in ((0, 17), (5, 5), (0, 999)):
        expected = all_shortest(edges, start, end)
        assert sorted(r["path"] for r in graph.shortest_paths(rows, start, end).collect()) == expected
        met = graph.meet(rows, start, end)
        dag = met.dag()
        assert {(r["src"], r["dst"]) for r in dag.collect()} == {e for p in expected for e in zip(p, p[1:], strict=False)}
        if expected:
            assert met.length() == len(expected[0]) - 1 and graph.path_total(dag, start, end, met.length()) == len(expected)


def test_paths_are_counted_before_they_are_written(spark):
    """A chain of diamonds, whose number of shortest paths doubles with each."""
    rungs = [(3 * i, 3 * i + k) for i in range(9) for k in (1, 2)] + [(3 * i + k, 3 * i + 3) for i in range(9) for k in (1, 2)]
    with pytest.raises(ValueError, match="more than 10"):
        graph.shortest_paths(table(spark, rungs), 0, 12, max_paths=10)
    met = graph.meet(table(spark, rungs), 0, 12)
    assert graph.path_total(met.dag(), 0, 12, met.length()) == 2**4


def test_progress_streams(spark):
    edges = table(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (1, 9)])
    page = spark.createDataFrame([(i, f"T{i}") for i in range(1, 6)], "page_id bigint, page_title string")
    lines = graph.ndjson(graph.shortest_path_stream(edges, 1, 5, page=page))
    first = json.loads(next(lines))
    assert first == {"visited": 1}  # it comes before the search has ended
    rest = [json.loads(x) for x in lines]
    assert [r["visited"] for r in rest] == sorted(r["visited"] for r in rest) and rest[-1]["titles"] == [["T1", "T2", "T3", "T4", "T5"]]
    records = list(graph.bfs_stream(edges, 1, 4, page=page))
    assert [r["visited"] for r in records] == [3, 4, 5, 5] and records[-1]["path"] == [1, 2, 3, 4] and records[-1]["titles"] == ["T1", "T2", "T3", "T4"]
    assert list(graph.bfs_stream(edges, 4, 1))[-1]["path"] == [] and list(graph.bfs_stream(edges, 2, 2))[-1]["path"] == [2]
    assert list(graph.bfs_stream(edges, 1, 5, max_depth=2))[-1]["path"] == []


def weakly_connected(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("edges", [random_edges(3, 200, 170) + [(500, i) for i in range(501, 550)], [(i, i + 1) for i in range(60)], [(7, 7)]])
def test_components_against_union_find(spark, edges):
    found = {r["page_id"]: r["component"] for r in graph.components(table(spark, edges)).collect()}
    assert found == weakly_connected(edges)


def modularity_of(edges, label):
    arcs = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    degree = collections.Counter(label[a] for a, _ in arcs)
    inside = sum(label[a] == label[b] for a, b in arcs)
    return inside / len(arcs) - sum(d * d for d in degree.values()) / len(arcs) ** 2


def test_communities_by_modularity(spark):
    """Planted groups: modularity at least that of the planted partition's neighbourhood and of label propagation, every community connected."""
    rng, groups, size = random.Random(4), 5, 8
    nodes = groups * size
    edges = [(g * size + rng.randrange(size), g * size + rng.randrange(size)) for g in range(groups) for _ in range(20)]
    edges += [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(15)]
    rows = table(spark, edges)
    label = {r["page_id"]: r["community"] for r in communities.communities(rows).collect()}
    assert set(label) == {n for a, b in edges if a != b for n in (a, b)}
    quality = modularity_of(edges, label)
    found = spark.createDataFrame(list(label.items()), "page_id bigint, community bigint")
    assert communities.modularity(rows, found).first()[0] == pytest.approx(quality)
    spread = {r["page_id"]: r["community"] for r in communities.label_propagation(rows).collect()}
    planted = {n: n // size for n in label}
    assert quality >= modularity_of(edges, spread) - 1e-9 and quality >= modularity_of(edges, planted) - 0.01
    inside = [(a, b) for a, b in edges if a != b and label[a] == label[b]]
    together = weakly_connected([*inside, *((n, n) for n in label)])
    assert all(together[n] == label[n] for n in label)


def test_communities_broadcast_no_table_of_nodes(spark, monkeypatch):
    """Every table that a level writes is joined by shuffles, however small the planner finds its sides."""
    plans = []
    for name in ("cut", "cut_counting"):
        real = getattr(communities, name)
        monkeypatch.setattr(communities, name, lambda df, real=real, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, **more))
    edges = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)])
    label = communities.communities(edges, max_levels=1, turns=2)
    plans.append(communities.modularity(edges, label)._jdf.queryExecution().executedPlan().toString())
    assert sum("ShuffledHashJoin" in p for p in plans) >= 5
    assert not any("Broadcast" in p for p in plans)


def test_communities_move_arcs_once_a_turn(spark, monkeypatch):
    """A turn has one exchange of arcs and three of nodes, and parts are sought once, after the last level, not on each."""
    plans, sought = [], []
    counting, parts = communities.cut_counting, communities.components
    monkeypatch.setattr(communities, "cut_counting", lambda df, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or counting(df, **more))
    monkeypatch.setattr(communities, "components", lambda edges: sought.append(edges) or parts(edges))
    edges = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)])
    assert communities.communities(edges, max_levels=1, turns=2).count() == 6
    assert plans and all(p.count("Exchange hashpartitioning") <= 4 for p in plans)
    assert len(sought) == 1


def test_refinement_keeps_communities_connected(spark):
    """Also: the modularity that a turn tells is that of the state it began with."""
    edges = random_edges(6, 40, 60)
    nodes = sorted({n for a, b in edges if a != b for n in (a, b)})
    pairs = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    degree = collections.Counter(a for a, _ in pairs)
    arcs = spark.createDataFrame([*((a, b, 1.0, float(degree[a])) for a, b in pairs), *((n, n, 0.0, float(degree[n])) for n in nodes)], "src bigint, dst bigint, weight double, degree double")
    graph_, total = tables.dealt(arcs, "dst"), float(len(pairs))
    state = spark.createDataFrame([(n, float(degree[n]), n) for n in nodes], "node bigint, degree double, community bigint").selectExpr("*", "xxhash64(node) AS seed")
    label, merged = {n: n for n in nodes}, 0
    for _ in range(3):
        state, moved, quality = communities._moved(graph_, state, total, 1.0, refine=True)
        assert quality == pytest.approx(modularity_of(edges, label))
        label, before = {r["node"]: r["community"] for r in state.collect()}, label
        assert moved == sum(label[n] != before[n] for n in nodes)
        merged += moved
        inside = [(a, b) for a, b in pairs if label[a] == label[b]]
        together = weakly_connected([*inside, *((n, n) for n in nodes)])
        assert len(set(together.values())) == len(set(label.values()))
    assert merged > 5
    assert communities._quality(graph_, state, total, 1.0) == pytest.approx(modularity_of(edges, label))
    tables.forget(graph_)


def test_communities_of_odd_graphs(spark):
    assert communities.communities(table(spark, [])).count() == 0
    assert communities.communities(table(spark, [(3, 3)])).count() == 0
    clique = [(a, b) for group in ([1, 2, 3, 4], [11, 12, 13, 14]) for a in group for b in group if a < b]
    label = {r["page_id"]: r["community"] for r in communities.communities(table(spark, [*clique, (4, 11), (11, 4), (4, 4)])).collect()}
    assert label == {**dict.fromkeys([1, 2, 3, 4], 1), **dict.fromkeys([11, 12, 13, 14], 11)}
    assert communities.modularity(table(spark, []), spark.createDataFrame([], "page_id bigint, community bigint")).first()[0] == 0


def test_summaries_name_only_the_deepest_nodes(spark, monkeypatch):
    """Against every node reached by name; several passes, a source twice and one that reaches nothing."""
    monkeypatch.setattr(graph, "WIDE", 1, raising=False)
    edges, sources = random_edges(5, 80, 150), [*range(66), 5, 1000]
    found = {r["source_id"]: (r["num_visited"], r["eccentricity"], r["deepest"]) for r in graph.summaries(table(spark, edges), sources).collect()}
    expected = {}
    for source in sources:
        depth = depths_from(edges, source)
        most = max(depth.values())
        expected[source] = (len(depth) - 1, most, min(n for n, d in depth.items() if d == most) if most else None)
    assert found == expected


def test_dealt_tables_join_in_place(spark):
    rows = spark.range(1000).selectExpr("id AS a", "id * 7 % 13 AS v")
    one, other = tables.dealt(rows, "a"), tables.dealt(rows.withColumnRenamed("a", "b"), "b")
    both = one.join(other.hint("shuffle_hash"), one["a"] == other["b"], "full_outer")
    assert both.count() == 1000
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_components_move_pairs_once_a_half_round(spark, monkeypatch):
    plans, real = [], graph.dealt

    def noted(df, key, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, key, **how)

    monkeypatch.setattr(graph, "dealt", noted)
    found = graph.components(table(spark, [(i + 1, i) for i in range(5, 12)] + [(50, 50), (7, 7)])).collect()
    assert sorted(tuple(r) for r in found) == [*((n, 5) for n in range(5, 13)), (50, 50)]
    assert len(plans) > 2
    assert all("Broadcast" not in p for p in plans)
    assert all(p.count("Exchange hashpartitioning") == 1 for p in plans[1:])
