"""Graph operators on small graphs with known answers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import community, edges, graph, links, ranking, traverse

EDGE = "id long, source_id string, target_id string, type string, confidence string, status string"


def vertices(spark, ids, **more):
    rows = [(i, n, i, more.get("classes", {}).get(i, "K"), "", more.get("myths", {}).get(i, "M"), "about", "F", "own")
            for n, i in enumerate(sorted(ids))]
    return spark.createDataFrame(
        rows, "id string, wiki_id int, name string, class_name string, prototype string, mythology string, "
              "description string, gender string, source string")


def edge_table(spark, pairs, rel_type="ALLY_OF"):
    return spark.createDataFrame(
        [(n, a, b, t[0] if t else rel_type, "high", "approved") for n, (a, b, *t) in enumerate(pairs)], EDGE)


# Two parts: a path with a triangle at its end, and a pair.
PAIRS = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("e", "g"), ("x", "y")]
IDS = "abcdefghxyz"


@pytest.fixture(scope="module")
def small(spark):
    return vertices(spark, IDS), edge_table(spark, PAIRS)


def test_canonical_edges_keep_the_first_of_both_directions(spark):
    table = edge_table(spark, [("a", "b", "PARENT_OF"), ("b", "a", "PARENT_OF"), ("a", "a"), ("a", "b"), ("a", "nobody")])
    kept = edges.canonical_edges(table, vertices(spark, "ab"))
    assert sorted(r["id"] for r in kept.collect()) == [0, 3]
    again = edges.canonical_edges(kept, vertices(spark, "ab"))
    assert sorted(again.collect()) == sorted(kept.collect())


def test_normal_form_turns_inverse_types(spark):
    table = edge_table(spark, [("kid", "mum", "CHILD_OF"), ("a", "b", " ALLY_OF "), ("a", "b", "NOTHING")])
    rows = {(r["source_id"], r["target_id"], r["type"]) for r in edges.normalize_edges(table).collect()}
    assert rows == {("mum", "kid", "PARENT_OF"), ("a", "b", "ALLY_OF")}


def test_degree_counts_distinct_neighbours(spark):
    table = edge_table(spark, [("a", "b"), ("b", "a", "ENEMY_OF"), ("a", "c")])
    assert dict(edges.degree(table).collect()) == {"a": 2, "b": 1, "c": 1}


def test_an_empty_filter_lets_nothing_pass(spark, small):
    v, e = small
    assert graph.filter_vertices(v, mythologies=[]).count() == 0
    assert graph.filter_vertices(v).count() == len(IDS)
    nodes, _ = graph.subgraph(v, e, search="no such name")
    assert nodes.count() == 0


def test_group_nodes_and_strict_types(spark, small):
    v, e = small
    nodes, rows = graph.subgraph(v, e, group_nodes=True, types=["ALLY_OF"], strict_types=True)
    assert nodes.filter("kind = 'myth'").select("id", "degree").collect()[0] == ("m:M", len(IDS))
    assert rows.filter("type = 'BELONGS_TO'").count() == 0


def test_ego_network_and_lonely_centre(spark, small):
    v, e = small
    centres = spark.createDataFrame([("a",), ("z",)], "id string")
    near = {(r["center"], r["id"], r["distance"]) for r in graph.ego_network(v, e, centres, 2).collect()}
    assert near == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("z", "z", 0)}
    alone = graph.ego_network(v, e, centres, 2, gender="M").collect()
    assert {(r["center"], r["id"]) for r in alone} == {("a", "a"), ("z", "z")}


def brute_distance(pairs, source):
    around = {}
    for a, b, *_ in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    seen, frontier = {source: 0}, [source]
    while frontier:
        frontier = [n for v in frontier for n in sorted(around.get(v, ())) if n not in seen and not seen.update({n: seen[v] + 1})]
    return seen


def test_shortest_paths(spark, small):
    v, e = small
    asked = list(itertools.product("abehxz", "acghyq"))
    pairs = spark.createDataFrame(asked, "source string, target string")
    found = {(r["source"], r["target"]): r for r in traverse.shortest_paths(v, e, pairs, max_hops=5).collect()}
    assert len(found) == len(set(asked))
    linked = {frozenset(p) for p in PAIRS}
    for (s, t), row in found.items():
        expected = brute_distance(PAIRS, s).get(t) if t in IDS else None
        if expected is None or expected > 5:
            assert not row["found"] and row["distance"] == 0
        else:
            assert row["found"] and row["distance"] == expected and row["nodes"][0] == s and row["nodes"][-1] == t
            assert all(frozenset(step) in linked for step in zip(row["nodes"], row["nodes"][1:]))


def test_distances_obey_the_triangle_rule(spark, small):
    _, e = small
    rows = traverse.bfs_distances(e, spark.createDataFrame([("a",)], "id string"), 7).collect()
    distance = {r["id"]: r["distance"] for r in rows}
    assert distance == brute_distance(PAIRS, "a")
    assert all(abs(distance[a] - distance[b]) <= 1 for a, b, *_ in PAIRS if a in distance)


def test_chains_and_hints(spark, small):
    _, e = small
    steps = [(n, pos, i) for n, chain in ((1, "abc"), (2, "abd"), (3, "a")) for pos, i in enumerate(chain)]
    steps = spark.createDataFrame(steps, "chain int, pos int, id string")
    checked = {r["chain"]: (r["links"], r["broken"], r["valid"]) for r in traverse.validate_chains(steps, e).collect()}
    assert checked == {1: (2, 0, True), 2: (2, 1, False), 3: (0, 0, True)}
    hint = traverse.next_hop(e, spark.createDataFrame([("a", "e"), ("a", "x")], "current string, target string")).collect()
    assert [(h["next_id"], h["distance"]) for h in hint] == [("b", 4)]


def test_generations(spark):
    table = edge_table(spark, [("gran", "mum", "PARENT_OF"), ("mum", "me", "PARENT_OF"), ("me", "kid", "PARENT_OF"),
                               ("me", "sis", "SIBLING_OF"), ("pal", "me", "ALLY_OF")])
    rows = traverse.generation_level(table, spark.createDataFrame([("me",)], "id string")).collect()
    assert {r["id"]: r["level"] for r in rows} == {"me": 0, "mum": -1, "gran": -2, "kid": 1, "sis": 0}


def test_puzzle_pairs_keep_their_distance(spark):
    ring = [(f"n{i:02}", f"n{(i + 1) % 16:02}") for i in range(16)]
    v, e = vertices(spark, {x for p in ring for x in p}), edge_table(spark, ring)
    seeds = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "seed string")
    first = traverse.sample_pairs_at_distance(v, e, seeds).collect()
    assert len(first) == 2
    for row in first:
        assert 3 <= brute_distance(ring, row["from_id"])[row["to_id"]] == row["distance"] <= 5
    assert sorted(first) == sorted(traverse.sample_pairs_at_distance(v, e, seeds).collect())


def test_communities_of_two_cliques(spark):
    one, two = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    pairs = [*itertools.combinations(one, 2), *itertools.combinations(two, 2), ("a0", "b0")]
    v, e = vertices(spark, [*one, *two, "lone"]), edge_table(spark, pairs)
    found = community.communities(v, e)
    of = dict(found.collect())
    assert of == {**dict.fromkeys(one, "a0"), **dict.fromkeys(two, "b0"), "lone": "lone"}
    parts = v.select("id", F.when(F.col("id") == "lone", "lone").otherwise("all").alias("community"))
    assert community.modularity(e, found) > community.modularity(e, parts)


def brute_suggestions(v, pairs, n):
    myth = dict(v.select("id", "mythology").collect())
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    rows = []
    for a, b in itertools.combinations(sorted(myth), 2):
        shared = around.get(a, set()) & around.get(b, set())
        if shared and b not in around[a] and myth[a] == myth[b] and myth[a]:
            rows.append((-len(shared), a, b, sorted(shared)[:6]))
    return [(a, b, -s, round(-s * 2.1, 2), ids) for s, a, b, ids in sorted(rows)[:n]]


@pytest.mark.parametrize("draw,seed,n", [(1, 1000, 15), (1, 2, 15), (2, 3, 5), (3, 1, 40), (4, 4, 200), (5, 2, 3)])
def test_suggestions_are_exact_with_hubs(spark, draw, seed, n):
    """A third of all edges sit on one vertex, and many vertices have the same neighbours."""
    rng = random.Random(draw)
    ids = [f"v{i:02}" for i in range(40)]
    pairs = {tuple(sorted(rng.sample(ids, 2))) for _ in range(40)}
    pairs |= {("hub", i) for i in ids if rng.random() < 0.8} | {("hub2", i) for i in ids[:20]}
    pairs |= {(ids[0], i) for i in ids[1:25]}
    v = vertices(spark, [*ids, "hub", "hub2"], myths={i: "MN"[n % 2] for n, i in enumerate(ids)} | {"hub": None, "hub2": ""})
    got = links.suggest_links(v, edge_table(spark, sorted(pairs)), n, seed=seed).collect()
    rows = [tuple(r) for r in sorted(got, key=lambda r: (-r["shared"], r["source_id"], r["target_id"]))]
    assert rows == brute_suggestions(v, pairs, n)


def test_suggestions_on_a_large_hub(spark):
    """Most pairs share the hub alone; the best ones are far down its members, and in small groups."""
    ids = [f"v{i:04}" for i in range(1500)]
    pairs = {("hub", i) for i in ids} | {("hub2", i) for i in ids[1490:]} | {("small", ids[3]), ("small", ids[1400])}
    pairs |= {("hub3", i) for i in ids[700:1495:5]}
    v = vertices(spark, [*ids, "hub", "hub2", "hub3", "small"], myths={i: None for i in ("hub", "hub2", "hub3", "small")})
    for n in (5, 60):
        got = links.suggest_links(v, edge_table(spark, sorted(pairs)), n).collect()
        assert [tuple(r) for r in sorted(got, key=lambda r: (-r["shared"], r["source_id"], r["target_id"]))] == brute_suggestions(v, pairs, n)


def test_suggestions_look_past_the_kept_members(spark):
    """The first members of a hub all know each other, so the first kept members are not enough."""
    ids = [f"v{i:03}" for i in range(90)]
    pairs = {("hub", i) for i in ids} | set(itertools.combinations(ids[:70], 2)) | {(a, b) for a in ids[:70] for b in ids[70:88]}
    v = vertices(spark, [*ids, "hub"], myths={"hub": None})
    got = links.suggest_links(v, edge_table(spark, sorted(pairs)), 3, seed=100).collect()
    want = brute_suggestions(v, pairs, 3)
    assert [tuple(r) for r in sorted(got, key=lambda r: (-r["shared"], r["source_id"], r["target_id"]))] == want
    got = links.suggest_links(v, edge_table(spark, sorted(pairs)), 3, seed=5).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: (-r["shared"], r["source_id"], r["target_id"]))] == want


def test_positions_are_dense_in_each_group(spark):
    rows = [(g, i) for g, size in (("a", 700), ("b", 3), (None, 5)) for i in range(size)]
    random.Random(7).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int").repartition(6)
    placed = ranking.with_position(df, ["i"], ["g"]).collect()
    assert len(placed) == len(rows) and all(r["position"] == r["i"] for r in placed)
    overall = ranking.with_position(df, ["g", "i"]).collect()
    assert sorted(r["position"] for r in overall) == list(range(len(rows)))


def test_a_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id")
    capped = ranking.cap_per_group(df, ["g"], ["id"], 4)
    assert capped._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    assert sorted(r["id"] for r in capped.collect()) == [0, 1, 2, 3, 4, 5, 6, 9]


def test_no_single_move_raises_modularity_much(spark):
    import random

    draw = random.Random(5)
    ends = [(f"n{draw.randrange(40) + 40 * b}", f"n{draw.randrange(40) + 40 * b}") for b in range(3) for _ in range(160)]
    ends += [(f"n{draw.randrange(120)}", f"n{draw.randrange(120)}") for _ in range(60)]
    rows = [(i, a, b, "ALLY_OF") for i, (a, b) in enumerate(ends) if a != b]
    e = spark.createDataFrame(rows, "id int, source_id string, target_id string, type string")
    v = spark.createDataFrame([(f"n{i}",) for i in range(120)], "id string")
    found = {r["id"]: r["community"] for r in community.communities(v, e).collect()}
    degree, total = {}, 0
    for _, a, b, _ in rows:
        degree[a], degree[b], total = degree.get(a, 0) + 1, degree.get(b, 0) + 1, total + 2

    def quality(of):
        weight = {}
        for node, k in degree.items():
            weight[of[node]] = weight.get(of[node], 0) + k
        return sum(2 for _, a, b, _ in rows if of[a] == of[b]) / total - sum((w / total) ** 2 for w in weight.values())

    reached = quality(found)
    planted = quality({f"n{i}": i // 40 for i in range(120)})
    assert len(found) == 120 and reached > 0.9 * planted > 0
    assert all(found[c] == c for c in found.values()) and len(set(found.values())) <= 12


def test_no_single_move_raises_modularity_at_all(spark):
    """Many small communities beside each other: each is a small share of all weight."""
    draw = random.Random(11)
    ends = {(6 * b + i, 6 * b + j) for b in range(250) for i, j in itertools.combinations(range(6), 2) if draw.random() < 0.6}
    ends |= {tuple(sorted(draw.sample(range(1500), 2))) for _ in range(900)}
    rows = [(i, f"n{a}", f"n{b}", "ALLY_OF") for i, (a, b) in enumerate(sorted(ends))]
    e = spark.createDataFrame(rows, "id int, source_id string, target_id string, type string")
    v = spark.createDataFrame([(f"n{i}",) for i in range(1500)], "id string")
    found = dict(community.communities(v, e).collect())
    around, weight, total = {}, {}, 2 * len(rows)
    for _, a, b, _ in rows:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    for node, near in around.items():
        weight[found[node]] = weight.get(found[node], 0) + len(near)
    for node, near in around.items():
        k, own = len(near), found[node]
        gains = {c: sum(found[x] == c for x in near) - k * (weight[c] - k * (c == own)) / total for c in {own, *(found[x] for x in near)}}
        assert max(gains.values()) <= gains[own] + 1e-8


def clusters(spark, parts, draw):
    """Groups of six vertices, with some edges across."""
    ends = {(6 * b + i, 6 * b + j) for b in range(parts) for i, j in itertools.combinations(range(6), 2) if draw.random() < 0.6}
    ends |= {tuple(sorted(draw.sample(range(6 * parts), 2))) for _ in range(3 * parts)}
    rows = [(i, f"n{a}", f"n{b}", "ALLY_OF") for i, (a, b) in enumerate(sorted(ends))]
    return (spark.createDataFrame([(f"n{i}",) for i in range(6 * parts)], "id string"),
            spark.createDataFrame(rows, "id int, source_id string, target_id string, type string"))


def test_communities_settle_in_few_turns(spark, monkeypatch):
    v, e = clusters(spark, 60, random.Random(7))
    turns = []
    choices = community._choices
    monkeypatch.setattr(community, "_choices", lambda *given: turns.append(1) or choices(*given))
    found = community.cut(community.communities(v, e))
    assert len(turns) <= 2  # turns over all nodes; one block holds this graph
    assert community.rising_moves(e, found).count() == 0


def test_moves_within_several_blocks_raise_modularity(spark):
    v, e = clusters(spark, 60, random.Random(8))
    links = community.cut(community._links(e))
    total = links.agg(F.sum("w")).first()[0]
    nodes = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("comm", F.col("node"))
    reached = [community.modularity(e, v.withColumn("community", F.col("id")))]
    state = nodes
    for turn in range(3):
        state = community.cut(community._within_blocks(state, links, total, 4, turn, community.LEAST_RISE, 100)).drop("moved")
        assert state.count() == nodes.count()
        reached.append(community.modularity(e, state.select(F.col("node").alias("id"), F.col("comm").alias("community"))))
    assert reached[0] < reached[1] < reached[2] <= reached[3]
    # A community of more nodes than a block holds stays as it is.
    whole = nodes.withColumn("comm", F.lit("n0"))
    assert not community._within_blocks(whole, links, total, 4, 0, community.LEAST_RISE, 100).filter("moved").count()


def test_closing_turns_need_no_turns_over_all_nodes(spark, monkeypatch):
    """Blocks of a level cannot see each other's moves; the vertices settle in larger ones at the end."""
    v, e = clusters(spark, 60, random.Random(9))
    asked, settled, choices = [], [], community._choices
    monkeypatch.setattr(community, "_choices", lambda *given: asked.append(len(settled)) or choices(*given))
    settle = community._settled
    monkeypatch.setattr(community, "_settled", lambda *given: settled.append(given[3]) or settle(*given))
    found = community.cut(community.communities(v, e, block=100))
    assert None in settled and asked  # closing turns have no limit
    assert all(settled[turn - 1] is not None for turn in asked)
    assert community.rising_moves(e, found).count() == 0


def plain_moves(k, comm, around, total):
    """Each node tried until none gains, without leaving any out."""
    of, weight, busy = list(comm), {}, True
    for c, x in zip(comm, k):
        weight[c] = weight.get(c, 0) + x
    while busy:
        busy, queue = False, list(range(len(of)))
        waiting = set(queue)
        while queue:
            node = queue.pop(0)
            waiting.discard(node)
            own, toward = of[node], {of[node]: 0.0}
            for other, w in around[node]:
                toward[of[other]] = toward.get(of[other], 0.0) + w
            stay = round(toward.pop(own) - k[node] * (weight[own] - k[node]) / total, 9)
            gain, best = min(((-round(w - k[node] * weight[c] / total, 9), c) for c, w in toward.items()), default=(-stay, own))
            if -gain - stay > community.LEAST_RISE:
                weight[own] -= k[node]
                weight[best] += k[node]
                of[node], busy = best, True
                for other, _ in around[node]:
                    if of[other] != best and other not in waiting:
                        waiting.add(other)
                        queue.append(other)
    return of


@pytest.mark.parametrize("draw,n,m,kinds", [(1, 60, 150, 1), (2, 200, 350, 1), (3, 80, 600, 3), (4, 300, 380, 2), (5, 3, 2, 1)])
def test_nodes_left_out_of_a_pass_would_have_stayed(draw, n, m, kinds):
    draw = random.Random(draw)
    ends = {tuple(sorted((draw.randrange(n), draw.randrange(n)))) for _ in range(m)}
    links = sorted((x, y, float(w)) for a, b in ends for w in [draw.randrange(kinds) + 1] for x, y in ((a, b), (b, a)))
    around = [[(y, w) for x, y, w in links if x == node] for node in range(n)]
    k = [sum(w for _, w in near) for near in around]
    comm = [draw.randrange(n) for _ in range(n)]
    src, dst, w = (np.array(column) for column in zip(*links))
    got = community._moved_one_by_one(np.array(k), np.array(comm), n, np.searchsorted(src, np.arange(n + 1)), dst, w, sum(k), community.LEAST_RISE)
    assert got.tolist() == plain_moves(k, comm, around, sum(k))


def test_modularity_reads_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)
    _, e = clusters(spark, 20, random.Random(10))

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    v = spark.createDataFrame([(f"n{i}", f"n{i // 6}") for i in range(120)], "id string, community string")
    rows = e.collect()
    got = community.modularity(e.coalesce(1).mapInArrow(count, e.schema), v)
    of, total = dict(v.collect()), 2 * len(rows)
    share = {}
    for r in rows:
        for end in (r["source_id"], r["target_id"]):
            share[of[end]] = share.get(of[end], 0) + 1
    inside = sum(2 for r in rows if of[r["source_id"]] == of[r["target_id"]])
    assert got == pytest.approx(inside / total - sum((n / total) ** 2 for n in share.values()))
    assert seen.value == len(rows)


def test_communities_do_not_depend_on_the_order_of_rows(spark):
    v, e = clusters(spark, 80, random.Random(12))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(community.communities(v, e.orderBy(F.rand(int(n)))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert found[0] == found[1]
