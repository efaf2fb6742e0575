"""Link suggestions: pairs of one group with shared neighbours and no edge yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.operators.edges import neighbors
from kinweave.operators.ranking import cap_per_group, top_n

POINTS_PER_SHARED = 2.1
LISTED_SHARED = 6


def suggest_links(vertices: DataFrame, edges: DataFrame, n: int = 20, seed: int = 16) -> DataFrame:
    """The ``n`` best suggestions: source_id, target_id, shared, score, shared_ids (first six).

    Pairs come from vertices of one mythology with a common neighbour, its group. Pairing off large
    groups would be quadratic, so first only ``seed`` members of each group are paired; the last of the
    ``n`` best pairs is then a mark that the result reaches anyhow. A member of a group can only be in a
    better pair if it is in enough other groups that are as large or larger, as the rarest neighbour of
    such a pair shows; few members of a large group are. The mark is raised with ``seed`` of those until
    that no longer helps, and then they are all paired, so that no pair is missed, whatever ``seed`` is.
    """
    nb = cut(neighbors(edges.filter(F.col("type") != "BELONGS_TO")))
    degrees = nb.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    grouped = vertices.filter(F.nullif("mythology", F.lit("")).isNotNull()).select("id", "mythology")
    entries = cut(_with_after(nb.join(grouped, F.col("src") == F.col("id")).select(
        F.col("dst").alias("center"), F.col("id").alias("member"), "mythology")))
    best, mark, size = None, None, seed
    while True:
        able = entries if mark is None else entries.filter(F.col("after") >= mark["shared"])
        some = cap_per_group(able, ["center", "mythology"], ["member"], size)
        found = _shared(_pairs(some, some), nb, degrees)
        best = cut(_best(found if best is None else best.unionByName(found).distinct(), n))
        last = best.agg(F.max(F.struct((-F.col("shared")).alias("rank"), "a", "b", "shared")).alias("at"),
                        F.count(F.lit(1)).alias("n")).first()
        now = last["at"] if last["n"] == n else None
        if now is None and not entries.groupBy("center", "mythology").count().filter(F.col("count") > size).isEmpty():
            size *= 4
        elif now is None or now == mark:
            break
        mark = now
    if mark is not None:
        more = entries.filter(F.col("after") >= mark["shared"])
        as_many = entries.filter(F.col("after") >= mark["shared"] - 1)
        pairs = _pairs(more, more).unionByName(_pairs(as_many.filter(F.col("member") <= mark["a"]), as_many)).distinct()
        best = cut(_best(best.unionByName(_shared(pairs, nb, degrees)).distinct(), n))
    return _listed(best, nb)


def _with_after(member: DataFrame) -> DataFrame:
    """Members of the groups with two or more, and ``after``: how many other groups that are as large or
    larger, to a power of two, each member is in."""
    groups = member.groupBy("center", "mythology").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sized = member.join(groups.withColumn("power", F.floor(F.log2("n")).cast("int")), ["center", "mythology"])
    of_member = Window.partitionBy("member").orderBy(F.desc("power")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = sized.groupBy("member", "power").agg(F.count(F.lit(1)).alias("groups"))
    after = counts.select("member", "power", (F.sum("groups").over(of_member) - 1).alias("after"))
    return sized.join(after, ["member", "power"]).select("center", "mythology", "member", "after")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs a < b of one group, once each."""
    return (left.select("center", "mythology", F.col("member").alias("a"))
            .join(right.select("center", "mythology", F.col("member").alias("b")), ["center", "mythology"])
            .filter(F.col("a") < F.col("b")).select("a", "b").distinct())


def _shared(pairs: DataFrame, nb: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pairs that are not linked, with the number of their common neighbours, looked up from the end that has fewer."""
    open_pairs = pairs.join(nb.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    ends = (open_pairs.join(degrees.select(F.col("id").alias("a"), F.col("degree").alias("degree_a")), "a")
            .join(degrees.select(F.col("id").alias("b"), F.col("degree").alias("degree_b")), "b"))
    fewer = F.col("degree_a") <= F.col("degree_b")
    asked = ends.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("src"),
                        F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    return (asked.join(nb, "src").join(nb.select(F.col("src").alias("other"), "dst"), ["other", "dst"], "left_semi")
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))


def _best(pairs: DataFrame, n: int) -> DataFrame:
    return top_n(pairs.select("a", "b", "shared"), [F.desc("shared"), "a", "b"], n)


def _listed(best: DataFrame, nb: DataFrame) -> DataFrame:
    """Attach the score and the first shared neighbours to the few chosen pairs."""
    shared = (
        best.join(nb.select(F.col("src").alias("a"), F.col("dst").alias("via")), "a")
        .join(nb.select(F.col("src").alias("b"), F.col("dst").alias("via")), ["b", "via"], "left_semi")
    )
    first = cap_per_group(shared.select("a", "b", "via"), ["a", "b"], ["via"], LISTED_SHARED)
    ids = first.groupBy("a", "b").agg(F.array_sort(F.collect_list("via")).alias("shared_ids"))
    return best.join(ids, ["a", "b"]).select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), "shared",
        F.round(F.col("shared") * POINTS_PER_SHARED, 2).alias("score"), "shared_ids",
    )
