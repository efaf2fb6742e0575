"""Communities by local moves that raise modularity, as rounds of joins and aggregates."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from kinweave import vocab
from kinweave.lineage import cut
from kinweave.operators.edges import both_ways
from kinweave.operators.ranking import top_n, with_position

#: A rise of the inner weight, in edges, that is above rounding errors.
LEAST_RISE = 1e-9
#: Above what rounding to nine digits does to a difference.
NEAR = 2e-9
#: Nodes that a task moves one after the other.
BLOCK = 50_000
#: The same for the closing turns of vertices, which end when none gains: blocks that cannot see each other's moves
#: would take many turns over everything for the last few.
CLOSING_BLOCK = 2_000_000
#: Links that a task holds at most, on average.
BLOCK_LINKS = 8_000_000


def communities(vertices: DataFrame, edges: DataFrame, levels: int | None = None,
                rounds: int = 4, least_rise: float = LEAST_RISE, block: int = BLOCK,
                closing_block: int = CLOSING_BLOCK) -> DataFrame:
    """A community for every vertex: id, community (its smallest member).

    Parallel edges weigh more. A turn begins with moves between communities dealt to the same block, one
    after the other in a task, see ``_within_blocks``. Then all nodes that gain by moving to a neighbouring
    community do so at once, but for those that would spoil each other's gain, see ``_moves``; so each
    turn raises modularity. After ``rounds`` turns communities become the nodes of the next level, until none gains
    more than ``least_rise`` edges by joining another. Then the vertices move again, from where they are,
    for as many turns as it takes until no move of one vertex raises modularity, in blocks of ``closing_block``
    nodes, and their communities are tried once more as nodes. ``levels`` ends all this earlier. Ties go to
    the present community, then to the smallest name, so a run can be repeated. Nodes go by their places
    in the order of names until the end.
    """
    named_links = cut(_links(edges))
    total = named_links.agg(F.sum("w")).first()[0]
    ids = vertices.select("id")
    if not total:
        return ids.select("id", F.col("id").alias("community"))
    weights = named_links.filter(F.col("src").isNotNull()).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    placed = cut(with_position(weights, ["id"], name="node"))
    src, dst = (placed.select(F.col("id").alias(end), F.col("node").alias(f"{end}_node")) for end in ("src", "dst"))
    links = cut(named_links.join(src, "src").join(dst, "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "w"))
    nodes = placed.select("node", "k", F.col("node").alias("comm"))
    of_vertex = nodes.select(F.col("node").alias("id"), "comm")
    vertex_nodes, vertex_links, state = nodes, links, nodes
    at_vertices, closing, level = True, False, 0
    while levels is None or level < levels:
        last = closing and at_vertices
        state, moved = _settled(state, links, total, None if last else rounds, least_rise, max(block, closing_block) if last else block)
        step = state.select("node", "comm")
        if at_vertices:
            of_vertex = step.withColumnRenamed("node", "id")
        elif moved:
            of_vertex = cut(of_vertex.withColumnRenamed("comm", "node").join(step, "node").select("id", "comm"))
        level += 1
        if not moved:
            if at_vertices:
                break
            # Communities are settled: the vertices take their turns in them.
            links, at_vertices, closing = vertex_links, True, True
            state = cut(vertex_nodes.select("node", "k").join(of_vertex.withColumnRenamed("id", "node"), "node"))
            continue
        at_vertices = False
        state = cut(state.groupBy(F.col("comm").alias("node")).agg(F.sum("k").alias("k"))).withColumn("comm", F.col("node"))
        ends = step.select(F.col("node").alias("src"), F.col("comm").alias("a"))
        others = step.select(F.col("node").alias("dst"), F.col("comm").alias("b"))
        links = cut(
            links.join(ends, "src").join(others, "dst").filter(F.col("a") != F.col("b"))
            .groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        )
    members = of_vertex.withColumnRenamed("id", "node").join(placed.select("node", "id"), "node")
    names = members.groupBy("comm").agg(F.min("id").alias("community"))
    named = members.join(names, "comm").select("id", "community")
    return ids.join(named, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _links(edges: DataFrame) -> DataFrame:
    """Both directions of the edges with their weights: src, dst, w."""
    pairs = both_ways(edges.filter(F.col("type") != "BELONGS_TO").select("source_id", "target_id"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _settled(state: DataFrame, links: DataFrame, total: float, rounds: int | None, least_rise: float,
             block: int) -> tuple[DataFrame, bool]:
    """Node, its weight k and its community after the turns of one level, and whether any node moved."""
    turn, moved = 0, False
    blocks = max(-(-state.count() // block), -(-links.count() // BLOCK_LINKS))
    while rounds is None or turn < rounds:
        inner = Observation()
        state = cut(_within_blocks(state, links, total, blocks, turn, least_rise, block).observe(
            inner, F.count_if("moved").alias("n"))).drop("moved")
        moved = moved or inner.get["n"] > 0
        if blocks == 1:  # all nodes have taken their turns, until none gained
            break
        seen = Observation()
        wishes = cut(_choices(state, links, total).filter(F.col("rise") > least_rise).observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            break
        moved = True
        moves = _moves(wishes, links, total).select(F.col("src").alias("node"), "to")
        state = cut(state.join(moves, "node", "left").select("node", "k", F.coalesce("to", "comm").alias("comm")))
        turn += 1
    return state, moved


def _within_blocks(state: DataFrame, links: DataFrame, total: float, blocks: int, turn: int, least_rise: float,
                   block: int) -> DataFrame:
    """State after moves within blocks of whole communities: node, k, comm, moved.

    A task holds all nodes of its communities and the links between them, so it knows what a move gains
    there, and no other block changes that; each move raises modularity. Blocks have some ``block``
    nodes and differ from turn to turn. Larger communities stay out; their nodes move in ``_moves``.
    """
    schema = StructType([*(state.schema[name] for name in ("node", "k", "comm")), StructField("moved", BooleanType())])
    settle = _one_by_one(total, least_rise)
    if blocks == 1:
        return (state.select("node", "k", "comm").groupBy(F.lit(0).alias("block"))
                .cogroup(links.select("src", "dst", "w").groupBy(F.lit(0).alias("block"))).applyInArrow(settle, schema))
    sizes = state.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))
    number = F.pmod(F.xxhash64("comm", F.lit(turn)), F.lit(blocks)).cast("int")
    dealt = cut(state.join(sizes, "comm").select("node", "k", "comm", F.when(F.col("n") <= block, number).alias("block")))
    known = dealt.filter(F.col("block").isNotNull())
    left, right = (known.select(F.col("node").alias(end), F.col("block").alias("part")) for end in ("src", "dst"))
    inner = links.join(left, "src").join(right, ["dst", "part"]).select("part", "src", "dst", "w")
    settled = known.groupBy("block").cogroup(inner.groupBy("part")).applyInArrow(settle, schema)
    return settled.unionByName(dealt.filter(F.col("block").isNull()).select("node", "k", "comm", F.lit(False).alias("moved")))


def _one_by_one(total: float, least_rise: float):
    """Moves of the nodes of one block, first in the order of their names, until none gains."""
    def settle(nodes: pa.Table, links: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        row, src, dst, k = (column.to_numpy() for column in (nodes["node"], links["src"], links["dst"], nodes["k"]))
        names, before = np.unique(nodes["comm"].to_numpy(), return_inverse=True)
        src, dst = np.searchsorted(row, src), np.searchsorted(row, dst)
        order = np.lexsort((dst, src))  # neighbours are tried again in the order of their names too, not of the rows
        starts = np.searchsorted(src[order], np.arange(len(row) + 1))
        of = _moved_one_by_one(k, before, len(names), starts, dst[order], links["w"].to_numpy()[order], total, least_rise)
        return pa.table({"node": nodes["node"], "k": nodes["k"], "comm": pa.array(names[of], nodes["comm"].type),
                         "moved": pa.array(of != before, pa.bool_())})

    return settle


def _moved_one_by_one(k: np.ndarray, comm: np.ndarray, n_comms: int, starts: np.ndarray, dst: np.ndarray, w: np.ndarray,
                      total: float, least_rise: float) -> np.ndarray:
    """Communities of nodes of weight ``k`` after their moves; node n has the links from ``starts[n]`` to ``starts[n + 1]``."""
    weights, of, starts, near = k.tolist(), comm.tolist(), starts.tolist(), dst.tolist()
    weight = np.bincount(comm, k, n_comms).tolist()
    kinds, kind = np.unique(w, return_inverse=True)
    by = list(map(kinds.tolist().__getitem__, kind.tolist()))  # equal numbers are kept once
    community = of.__getitem__
    # How much less a node got from the best other community when it was last tried, less all that weights of
    # communities can have done to it in the passes since then. What its neighbours' moves do has it tried again.
    reserve = [-1.0] * len(of)
    busy = True
    while busy:
        # Neighbours of what moved are tried again at once, all others when none of those gains.
        busy, queue, queued = False, deque(range(len(of))), bytearray(b"\1") * len(of)
        low, high, drift = weight[:], weight[:], 0.0  # of each community in this pass
        while queue:
            node = queue.popleft()
            queued[node], k_node = 0, weights[node]
            if reserve[node] > k_node * drift:
                continue
            own, first, last = of[node], starts[node], starts[node + 1]
            toward = {own: 0.0}
            for c, x in zip(map(community, near[first:last]), by[first:last]):
                toward[c] = toward[c] + x if c in toward else x
            stay = toward.pop(own) - k_node * (weight[own] - k_node) / total
            if not toward:
                reserve[node] = math.inf
                continue
            most = second = -math.inf
            for c, x in toward.items():
                gain = x - k_node * weight[c] / total
                if gain > most:
                    second, most, best = most, gain, c
                elif gain > second:
                    second = gain
            if stay - most > NEAR:
                reserve[node] = stay - most - NEAR
                continue
            reserve[node] = -1.0
            top = round(most, 9)
            if top - round(stay, 9) > least_rise:
                if most - second < NEAR:  # a tie, when rounded
                    best = min(c for c, x in toward.items() if round(x - k_node * weight[c] / total, 9) == top)
                weight[own] -= k_node
                weight[best] += k_node
                low[own], high[best] = min(low[own], weight[own]), max(high[best], weight[best])
                drift = max(drift, 2 * (high[own] - low[own]) / total, 2 * (high[best] - low[best]) / total)
                of[node], busy = best, True
                for other in near[first:last]:
                    if of[other] != best:
                        reserve[other] = -1.0
                        if not queued[other]:
                            queued[other] = 1
                            queue.append(other)
        reserve = (np.array(reserve) - k * drift).tolist()
    return np.array(of, dtype=np.int64)


def _choices(state: DataFrame, links: DataFrame, total: float) -> DataFrame:
    """Where each node gains most: src, k, own, to, rise (in edges)."""
    weights = state.groupBy("comm").agg(F.sum("k").alias("weight"))
    toward = (
        links.join(state.select(F.col("node").alias("dst"), "comm"), "dst")
        .select("src", "comm", "w")
        .unionByName(state.select(F.col("node").alias("src"), "comm", F.lit(0.0).alias("w")))
        .groupBy("src", "comm").agg(F.sum("w").alias("w"))
    )
    own = F.col("comm") == F.col("own")
    rest = F.col("weight") - F.when(own, F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - F.col("k") * rest / F.lit(total), 9)
    return (
        toward.join(state.select(F.col("node").alias("src"), "k", F.col("comm").alias("own")), "src")
        .join(weights, "comm")
        .groupBy("src", "own", "k").agg(F.min(F.struct((-gain).alias("g"), (~own).alias("o"), "comm")).alias("best"),
                                        F.max(F.when(own, gain)).alias("stay"))
        .select("src", "k", "own", F.col("best.comm").alias("to"), (-F.col("best.g") - F.col("stay")).alias("rise"))
    )


def _moves(wishes: DataFrame, links: DataFrame, total: float) -> DataFrame:
    """Moves that can be made at once so that what is gained is more than what they spoil.

    A node loses what it counted on if a neighbour leaves the community that it moves to; of two such
    nodes the one with the smaller rise stays. Nodes that leave one community together, or enter one,
    weigh on each other by the product of their weights; a node moves if its rise is more than all that,
    or if it gains most of those that leave its community and of those that enter the other one. What
    other moves share is never less than nothing, so the rises kept add up to a rise. The node that
    gains most of all always moves.
    """
    rank = F.struct((-F.col("rise")).alias("r"), F.col("src").alias("node"))
    ranked = wishes.select("src", "own", "to", rank.alias("rank"))
    spoiled = (
        links.select("src", "dst").join(ranked.select("src", "to", "rank"), "src")
        .join(ranked.select(F.col("src").alias("dst"), "own", F.col("rank").alias("other")), "dst")
        .filter(F.col("to") == F.col("own"))
        .select(F.greatest("rank", "other")["node"].alias("src")).distinct()
    )
    wished = wishes.withColumn("rank", rank)
    leaving = wished.groupBy("own").agg(F.sum("k").alias("out"), F.min("rank").alias("first_out"))
    coming = wished.groupBy("to").agg(F.sum("k").alias("in"), F.min("rank").alias("first_in"))
    weighs = F.col("k") * (F.col("in") + F.col("out") - 2 * F.col("k")) / F.lit(total)
    first = (F.col("rank") == F.col("first_out")) & (F.col("rank") == F.col("first_in"))
    return (wished.join(spoiled, "src", "left_anti").join(leaving, "own").join(coming, "to")
            .filter(first | (F.col("rise") > weighs)).select("src", "to"))


def rising_moves(edges: DataFrame, assignment: DataFrame, least_rise: float = LEAST_RISE) -> DataFrame:
    """Vertices that another community would suit better: id, community, better, rise (in edges)."""
    links = cut(_links(edges))
    total = links.agg(F.sum("w")).first()[0] or 1.0
    nodes = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    state = cut(nodes.join(assignment.select(F.col("id").alias("node"), F.col("community").alias("comm")), "node"))
    return _choices(state, links, total).filter(F.col("rise") > least_rise).select(
        F.col("src").alias("id"), F.col("own").alias("community"), F.col("to").alias("better"), "rise")


def modularity(edges: DataFrame, assignment: DataFrame) -> float:
    """Newman modularity of a partition (id, community)."""
    pairs = both_ways(edges.filter(F.col("type") != "BELONGS_TO").select("source_id", "target_id"))
    comm = assignment.select("id", "community")
    seen = pairs.join(comm.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(
        comm.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst"
    )
    ends = seen.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    share = F.col("n").cast("double")
    total, inside, squares = ends.agg(F.sum("n"), F.sum("inside"), F.sum(share * share)).first()
    return inside / total - squares / total**2 if total else 0.0


def top_mythology(vertices: DataFrame, assignment: DataFrame) -> DataFrame:
    """Size and commonest mythology per community; ties go to the smaller name."""
    named = assignment.join(
        vertices.select("id", F.coalesce(F.nullif("mythology", F.lit("")), F.lit(vocab.OTHER_GROUP)).alias("mythology")),
        "id",
    )
    counts = named.groupBy("community", "mythology").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("community").agg(
        F.sum("n").alias("size"),
        F.min_by("mythology", F.struct((-F.col("n")).alias("n"), "mythology")).alias("top_mythology"),
    )


def community_summary(vertices: DataFrame, assignment: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` largest communities with size and commonest mythology."""
    return top_n(top_mythology(vertices, assignment), [F.desc("size"), "community"], n)


def community_members(summary: DataFrame, assignment: DataFrame) -> DataFrame:
    """Members of the listed communities, one row each."""
    return assignment.join(summary.select("community"), "community", "left_semi").select("community", "id")
