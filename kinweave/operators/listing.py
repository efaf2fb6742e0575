"""Entity and edge listings, facets, profiles, exports in table form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions.rules import look_up
from kinweave.operators.edges import degree, is_directed, type_label
from kinweave.operators.ranking import page


def with_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def list_entities(
    vertices: DataFrame,
    edges: DataFrame,
    *,
    mythology: str | None = None,
    class_name: str | None = None,
    gender: str | None = None,
    has_relation: bool | None = None,
    search: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of entities in wiki_id order, with degree. ``search`` is a part of the name."""
    kept = vertices
    for column, wanted in (("mythology", mythology), ("class_name", class_name), ("gender", gender)):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    if search is not None:
        kept = kept.filter(F.contains("name", F.lit(search)))
    kept = with_degree(kept, edges).withColumn("has_relation", F.col("degree") > 0)
    if has_relation is not None:
        kept = kept.filter(F.col("has_relation") == has_relation)
    columns = ["id", "wiki_id", "name", "class_name", "mythology", "degree", "has_relation"]
    return page(kept.select(*columns), ["wiki_id", "id"], limit, offset)


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column that are not empty: facet, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter(F.nullif("value", F.lit("")).isNotNull()).distinct()


def mythology_counts(vertices: DataFrame) -> DataFrame:
    """Entities per mythology, largest first."""
    named = vertices.filter(F.nullif("mythology", F.lit("")).isNotNull())
    return named.groupBy("mythology").agg(F.count(F.lit(1)).alias("entities")).orderBy(F.desc("entities"), "mythology")


def present_types(edges: DataFrame) -> DataFrame:
    """Relation types in use by category, then name; memberships left out."""
    categories = {t: category for t, (_, category, _) in vocab.RELATION_TYPES.items()}
    used = edges.filter(F.col("type") != "BELONGS_TO").groupBy("type").agg(F.count(F.lit(1)).alias("edges"))
    return used.select(
        "type", F.coalesce(look_up(categories, F.col("type")), F.lit("")).alias("category"),
        type_label(F.col("type")).alias("label"), "edges",
    ).orderBy("category", "type")


def entity_profile(vertices: DataFrame, aliases: DataFrame, edges: DataFrame,
                   ids: DataFrame | None = None) -> DataFrame:
    """Each entity with degree and number of aliases; see ``entity_aliases`` for the names."""
    kept = vertices if ids is None else vertices.join(ids.select("id"), "id", "left_semi")
    counts = entity_aliases(aliases, ids).groupBy("id").agg(F.count(F.lit(1)).alias("aliases"))
    return with_degree(kept, edges).join(counts, "id", "left").withColumn(
        "aliases", F.coalesce("aliases", F.lit(0))
    )


def entity_aliases(aliases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Distinct aliases, one row each, of the entities asked for."""
    kept = aliases if ids is None else aliases.join(ids.select("id"), "id", "left_semi")
    return kept.select("id", "alias").distinct()


def with_names(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Add the names of both ends; an unknown end is named by its id."""
    names = vertices.select("id", "name")
    named = edges
    for end, column in (("source_id", "source_name"), ("target_id", "target_name")):
        named = named.join(names.select(F.col("id").alias(end), F.col("name").alias(column)), end, "left")
        named = named.withColumn(column, F.coalesce(column, end))
    return named.withColumn("directed", is_directed(F.col("type")))


def incident_edges(edges: DataFrame, vertices: DataFrame, ids: DataFrame, include_pending: bool = False) -> DataFrame:
    """Edges that touch one of ``ids``, with names: entity_id and the edge.

    Each edge is laid out by its ends and joined on equality. A self-loop is listed once.
    """
    kept = edges if include_pending else edges.filter(F.col("status") == "approved")
    wanted = ids.select(F.col("id").alias("entity_id")).distinct()
    ends = F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id")
    return with_names(kept.select(ends, *kept.columns).join(wanted, "entity_id"), vertices)


def filter_edges(edges: DataFrame, *, status: str | None = None, origin: str | None = None, type: str | None = None,
                 confidence: str | None = None, entity_id: str | None = None) -> DataFrame:
    kept = edges
    for column, wanted in (("status", status), ("origin", origin), ("type", type), ("confidence", confidence)):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    if entity_id is not None:
        kept = kept.filter((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))
    return kept


def list_edges(edges: DataFrame, vertices: DataFrame, *, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """One page of edges, newest first, with names. Names are joined to the page only."""
    chosen = page(filter_edges(edges, **filters), [F.desc("id")], limit, offset)
    return with_names(chosen, vertices)


def count_edges(edges: DataFrame, **filters) -> DataFrame:
    """Number of edges that a listing with these filters has in all."""
    return filter_edges(edges, **filters).agg(F.count(F.lit(1)).alias("total"))


def pending_queue(edges: DataFrame, vertices: DataFrame, *, limit: int = 50, origin: str | None = None) -> DataFrame:
    """Edges that wait for review, newest first."""
    return list_edges(edges, vertices, status="pending", origin=origin, limit=limit)


def edges_export(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge rows of the CSV export: both ids, both names, type and label."""
    named = with_names(edges, vertices)
    return named.select("source_id", "source_name", "target_id", "target_name",
                        F.col("type").alias("relationship"), type_label(F.col("type")).alias("label"))


def nodes_export(vertices: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Node rows of the CSV export with degree; with ``limit``, the first in wiki_id order."""
    listed = vertices if limit is None else page(vertices, ["wiki_id", "id"], limit)
    return with_degree(listed, edges).select(
        "id", "name", F.col("class_name").alias("class"), F.coalesce("mythology", F.lit("")).alias("mythology"),
        "gender", "degree", "wiki_id",
    )
