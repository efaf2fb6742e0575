"""Sub-graph views: filters, text hits with their neighbours, ego networks, group nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.operators.edges import degree, end_ids, neighbors
from kinweave.operators.ranking import cap_per_group
from kinweave.operators.traverse import within_hops


def search_expand(vertices: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Ids of the entities whose name or prototype contains ``text``, and of their neighbours."""
    hit = F.contains("name", F.lit(text)) | F.contains(F.coalesce("prototype", F.lit("")), F.lit(text))
    hits = vertices.filter(hit).select("id")
    around = neighbors(edges).join(hits, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    return hits.union(around).distinct()


def filter_vertices(
    vertices: DataFrame,
    *,
    mythologies: Sequence[str] | None = None,
    classes: Sequence[str] | None = None,
    gender: str | None = None,
    source: str | None = None,
    max_wiki_id: int | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Entities that pass every filter given. ``None`` is no filter; an empty list passes nothing."""
    kept = vertices
    if mythologies is not None:
        kept = kept.filter(F.col("mythology").isin(*mythologies))
    if classes is not None:
        kept = kept.filter(F.col("class_name").isin(*classes))
    if gender is not None:
        kept = kept.filter(F.col("gender") == gender)
    if source is not None:
        kept = kept.filter(F.col("source") == source)
    if max_wiki_id is not None:
        kept = kept.filter(F.col("wiki_id") <= max_wiki_id)
    if ids is not None:
        kept = kept.join(ids.select("id"), "id", "left_semi")
    return kept


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    kept = edges
    for end in ("source_id", "target_id"):
        kept = kept.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return kept.select(*edges.columns)


def subgraph(
    vertices: DataFrame,
    edges: DataFrame,
    *,
    types: Sequence[str] | None = None,
    search: str | None = None,
    only_related: bool = False,
    group_nodes: bool = False,
    strict_types: bool = False,
    ego: DataFrame | None = None,
    **filters,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a filtered view of the graph.

    Each node carries its degree in the whole graph. ``ego`` is a table of ids to stay within.
    ``strict_types`` lets ``types`` take away the membership links of group nodes too.
    """
    allowed = filter_vertices(vertices, **filters)
    if search is not None:
        allowed = allowed.join(search_expand(vertices, edges, search), "id", "left_semi")
    if ego is not None:
        allowed = allowed.join(ego.select("id"), "id", "left_semi")
    links = edges if types is None else edges.filter(F.col("type").isin(*types))
    links = induced_edges(links, allowed).select("source_id", "target_id", "type", "confidence")
    if only_related:
        allowed = allowed.join(end_ids(links), "id", "left_semi")
    nodes = (
        allowed.join(degree(edges), "id", "left")
        .select("id", "name", F.lit("character").alias("kind"), "mythology", "class_name",
                F.coalesce("degree", F.lit(0)).alias("degree"), "wiki_id")
    )
    if not group_nodes:
        return nodes, links
    nodes, links = with_group_nodes(nodes, links)
    if strict_types and types is not None:
        links = links.filter(F.col("type").isin(*types))
    return nodes, links


def with_group_nodes(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add one node per mythology and a membership link from each entity to it."""
    group = F.coalesce(F.nullif("mythology", F.lit("")), F.lit(vocab.OTHER_GROUP))
    grouped = (
        nodes.groupBy(group.alias("name")).agg(F.count(F.lit(1)).alias("degree"))
        .select(F.concat(F.lit("m:"), "name").alias("id"), "name", F.lit("myth").alias("kind"),
                F.col("name").alias("mythology"), F.lit("").alias("class_name"), "degree",
                F.lit(0).alias("wiki_id"))
    )
    belongs = nodes.select(
        F.col("id").alias("source_id"), F.concat(F.lit("m:"), group).alias("target_id"),
        F.lit("BELONGS_TO").alias("type"), F.lit("verified").alias("confidence"),
    )
    return nodes.unionByName(grouped), links.unionByName(belongs)


def ego_network(vertices: DataFrame, edges: DataFrame, centers: DataFrame, hops: int = 1,
                **filters) -> DataFrame:
    """Vertices within ``hops`` of each centre: center, id, distance.

    With filters, only vertices that pass are kept; a centre that is left with nothing keeps itself.
    """
    starts = centers.select(F.col("id").alias("key"), "id").join(vertices.select("id"), "id", "left_semi").distinct()
    near = within_hops(neighbors(edges), starts, hops).select(F.col("key").alias("center"), "id", "distance")
    if not filters:
        return near
    passed = near.join(filter_vertices(vertices, **filters).select("id"), "id", "left_semi")
    passed = passed.select("center", "id", "distance")
    alone = (
        starts.select(F.col("key").alias("center"), "id", F.lit(0).alias("distance"))
        .join(passed.select("center"), "center", "left_anti")
    )
    return passed.unionByName(alone)


def ego_links(edges: DataFrame, near: DataFrame, key: str = "center") -> DataFrame:
    """Edges with both ends in the same network of ``near`` (key, id)."""
    half = near.select(key, F.col("id").alias("source_id")).join(edges, "source_id")
    ends = near.select(key, F.col("id").alias("target_id"))
    return half.join(ends, [key, "target_id"], "left_semi").select(key, *edges.columns)


def context_subgraph(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1,
                     cap: int = 80) -> DataFrame:
    """Ids around the seeds of each question, at most ``cap`` per question in id order: key, id."""
    known = seeds.select("key", "id").join(vertices.select("id"), "id", "left_semi").select("key", "id").distinct()
    nb = neighbors(edges)
    reached = within_hops(nb, known, hops, stop_at=cap)
    return cap_per_group(reached.select("key", "id"), ["key"], ["id"], cap)


def family_tree(vertices: DataFrame, edges: DataFrame, roots: DataFrame,
                generations: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members (root, id, distance) and family links of each root's family."""
    family = edges.filter(F.col("type").isin(*vocab.FAMILY_TYPES))
    members = ego_network(vertices, family, roots, generations).withColumnRenamed("center", "root")
    return members, ego_links(family, members, "root")
