"""Breadth-first work over edge tables: distances, paths, generations, puzzle pairs.

All starts advance together, one join per level. Levels are keyed by start, so the work of many
starts spreads over the cluster; each level is written before the next one uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.lineage import cut
from kinweave.operators.edges import both_ways, neighbors, type_label
from kinweave.operators.ranking import first_per_key, pick_by_hash


def within_hops(nb: DataFrame, starts: DataFrame, hops: int, stop_at: int | None = None) -> DataFrame:
    """All (key, id) reachable in at most ``hops`` steps of ``nb`` (src, dst), with distance.

    ``stop_at`` ends a key's walk after the level at which it has that many vertices.
    """
    reached = cut(starts.select("key", "id").distinct().withColumn("distance", F.lit(0)))
    frontier = reached
    for level in range(1, hops + 1):
        if stop_at is not None:
            full = reached.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= stop_at)
            frontier = frontier.join(full, "key", "left_anti")
        step = (
            frontier.join(nb, F.col("id") == F.col("src")).select("key", F.col("dst").alias("id")).distinct()
            .join(reached.select("key", "id"), ["key", "id"], "left_anti")
            .withColumn("distance", F.lit(level))
        )
        frontier = cut(step)
        reached = reached.unionByName(frontier)
        if level < hops and frontier.isEmpty():
            break
    return reached


def bfs_distances(edges: DataFrame, sources: DataFrame, max_hops: int = 6) -> DataFrame:
    """Distance from each source (id) over all edges but memberships: source, id, distance."""
    walked = edges.filter(F.col("type") != "BELONGS_TO")
    starts = sources.select(F.col("id").alias("key"), "id")
    return within_hops(neighbors(walked), starts, max_hops).withColumnRenamed("key", "source")


def _advance(nb: DataFrame, frontier: DataFrame, reached: DataFrame) -> DataFrame:
    """One level further; each vertex keeps the smallest of its shortest walks."""
    step = (
        frontier.join(nb, F.col("id") == F.col("src"))
        .select("pair", F.col("dst").alias("id"), F.concat("walk", F.array("dst")).alias("walk"))
        .groupBy("pair", "id").agg(F.min("walk").alias("walk"))
        .join(reached.select("pair", "id"), ["pair", "id"], "left_anti")
    )
    return cut(step)


def shortest_paths(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """A shortest path for each (source, target): source, target, found, distance, nodes.

    The walk goes from both ends in turn, so no frontier is deeper than half the limit, and a pair
    leaves the work as soon as its two halves meet. Unknown ends and pairs beyond ``max_hops`` come
    back with ``found`` false and distance 0.
    """
    nb = cut(neighbors(edges))
    ids = vertices.select("id")
    asked = pairs.select("source", "target").distinct().withColumn("pair", F.struct("source", "target"))
    for end in ("source", "target"):
        asked = asked.join(ids.withColumnRenamed("id", end), end, "left_semi")
    heads = cut(asked.select("pair", F.col("source").alias("id"), F.array("source").alias("walk")))
    tails = cut(asked.select("pair", F.col("target").alias("id"), F.array("target").alias("walk")))
    met = _meet(heads, tails)
    reached = {"head": heads, "tail": tails}
    frontier = {"head": heads, "tail": tails}
    for hop in range(max_hops):
        near, far = ("head", "tail") if hop % 2 == 0 else ("tail", "head")
        open_frontier = frontier[near].join(met, "pair", "left_anti")
        frontier[near] = _advance(nb, open_frontier, reached[near])
        reached[near] = reached[near].unionByName(frontier[near])
        newly = _meet(frontier[near], reached[far]) if near == "head" else _meet(reached[far], frontier[near])
        newly = cut(newly)
        met = met.unionByName(newly)
        if frontier[near].isEmpty():
            break
    found = met.select("pair.*", F.lit(True).alias("found"), (F.size("nodes") - 1).alias("distance"), "nodes")
    missed = (
        pairs.select("source", "target").distinct().join(found, ["source", "target"], "left_anti")
        .select("source", "target", F.lit(False).alias("found"), F.lit(0).alias("distance"),
                F.array().cast("array<string>").alias("nodes"))
    )
    return found.unionByName(missed)


def _meet(heads: DataFrame, tails: DataFrame) -> DataFrame:
    """Whole walks of the pairs whose halves share a vertex; per pair the shortest, then smallest."""
    head = heads.select("pair", "id", F.col("walk").alias("head"))
    tail = tails.select("pair", "id", F.col("walk").alias("tail"))
    whole = F.concat("head", F.slice(F.reverse("tail"), 2, F.size("tail")))
    return (
        head.join(tail, ["pair", "id"]).select("pair", whole.alias("nodes"))
        .groupBy("pair").agg(F.min_by("nodes", F.struct(F.size("nodes"), "nodes")).alias("nodes"))
    )


def path_steps(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per step of each path, with the type and label of the smallest edge between its ends."""
    steps = paths.select("source", "target", F.posexplode("nodes").alias("step", "from_id"), "nodes").select(
        "source", "target", "step", "from_id", F.get("nodes", F.col("step") + 1).alias("to_id")
    ).filter(F.col("to_id").isNotNull())
    seen = both_ways(edges.select("id", "source_id", "target_id", "type"))
    named = first_per_key(
        seen.join(steps.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct(),
                  ["src", "dst"], "left_semi").select("src", "dst", "id", "type"),
        ["src", "dst"], ["id"],
    )
    return steps.join(
        named, (F.col("from_id") == F.col("src")) & (F.col("to_id") == F.col("dst"))
    ).select("source", "target", "step", "from_id", "to_id", "type", type_label(F.col("type")).alias("label"))


def validate_chains(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Check chains given as steps (chain, pos, id): chain, links, broken (links that are no edge), valid.

    ``pos`` counts up by one. A step meets its successor by an equi-join, so a chain may be any length.
    """
    walked = neighbors(edges.filter(F.col("type") != "BELONGS_TO"))
    following = steps.select("chain", (F.col("pos") - 1).alias("pos"), F.col("id").alias("dst"))
    links = steps.select("chain", "pos", F.col("id").alias("src")).join(following, ["chain", "pos"], "left")
    checked = links.join(walked.withColumn("known", F.lit(True)), ["src", "dst"], "left")
    real = F.col("dst").isNotNull()
    return checked.groupBy("chain").agg(
        F.count_if(real).alias("links"),
        F.count_if(real & F.col("known").isNull()).alias("broken"),
    ).withColumn("valid", F.col("broken") == 0)


def next_hop(edges: DataFrame, asks: DataFrame, max_hops: int = 6) -> DataFrame:
    """The smallest neighbour of ``current`` that is one step nearer to ``target``."""
    walked = edges.filter(F.col("type") != "BELONGS_TO")
    nb = neighbors(walked)
    asked = asks.select("current", "target").distinct()
    from_target = cut(within_hops(nb, asked.select(F.col("target").alias("key"), F.col("target").alias("id")), max_hops))
    here = asked.join(
        from_target.select(F.col("key").alias("target"), F.col("id").alias("current"), "distance"),
        ["target", "current"],
    )
    around = here.join(nb, F.col("current") == F.col("src")).select("current", "target", "dst", "distance")
    nearer = from_target.select(F.col("key").alias("target"), F.col("id").alias("dst"),
                                (F.col("distance") + 1).alias("distance"))
    return (
        around.join(nearer, ["target", "dst", "distance"])
        .groupBy("current", "target").agg(F.min("dst").alias("next_id"), F.first("distance").alias("distance"))
    )


def generation_level(edges: DataFrame, roots: DataFrame, generations: int = 3) -> DataFrame:
    """Signed generation of each relative: parents above (-1), children below (+1), others level.

    A vertex takes the level at which it is first reached, the smallest one on ties.
    """
    shift = F.when(F.col("type") == "PARENT_OF", 1).otherwise(0)
    kin = both_ways(edges.filter(F.col("type").isin(*vocab.FAMILY_TYPES)).select(
        "source_id", "target_id", shift.alias("shift"), F.col("source_id").alias("upper")))
    signed = F.when(F.col("src") == F.col("upper"), F.col("shift")).otherwise(-F.col("shift"))
    steps = kin.groupBy("src", "dst").agg(F.min(signed).alias("shift"))
    reached = cut(roots.select(F.col("id").alias("root"), "id").distinct()
                  .withColumns({"hops": F.lit(0), "level": F.lit(0)}))
    frontier = reached
    for hop in range(1, generations + 1):
        frontier = cut(
            frontier.join(steps, F.col("id") == F.col("src"))
            .groupBy("root", F.col("dst").alias("id")).agg(F.min(F.col("level") + F.col("shift")).alias("level"))
            .join(reached.select("root", "id"), ["root", "id"], "left_anti")
            .select("root", "id", F.lit(hop).alias("hops"), "level")
        )
        reached = reached.unionByName(frontier)
    return reached


def sample_pairs_at_distance(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, low: int = 3, high: int = 5,
                             min_links: int = 2, attempts: int = 12, min_choices: int = 3) -> DataFrame:
    """For each seed text a start and an end whose distance lies in ``low``..``high``.

    Starts need ``min_links`` links; the first of ``attempts`` starts that offers ``min_choices`` ends
    counts. Both picks hash the seed, so a seed always gives the same pair.
    """
    eligible = vertices.filter(
        ~F.col("class_name").isin(vocab.PROTOTYPE_CLASS, vocab.MYTH_PERSON_CLASS)
    ).select("id")
    links = both_ways(edges.filter(F.col("type") != "BELONGS_TO").select("source_id", "target_id"))
    linked = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_links)
    tries = seeds.select("seed", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    tries = tries.withColumn("from_seed", F.concat_ws("-", "seed", F.lit("from"), "attempt"))
    starts = cut(pick_by_hash(eligible.join(linked, "id", "left_semi"), tries, seed="from_seed"))
    ring = (
        bfs_distances(edges, starts.select("id").distinct(), high)
        .filter(F.col("distance").between(low, high)).join(eligible, "id", "left_semi")
        .select("source", "id", "distance")
    )
    choices = ring.groupBy("source").agg(F.count(F.lit(1)).alias("choices")).filter(F.col("choices") >= min_choices)
    picked = starts.join(choices, F.col("id") == F.col("source"))
    picked = first_per_key(picked.select("seed", "attempt", "source", "choices"), ["seed"], ["attempt"])
    # The end is the member of the ring with the smallest hash of seed and id: no numbering of the ring.
    by_hash = F.sha2(F.concat_ws("-", "seed", F.lit("to"), "attempt", "id"), 256)
    ends = picked.join(ring, "source").withColumn("draw", by_hash)
    return first_per_key(
        ends.select("seed", F.col("source").alias("from_id"), F.col("id").alias("to_id"), "distance", "choices", "draw"),
        ["seed"], ["draw", "to_id"],
    ).drop("draw")
