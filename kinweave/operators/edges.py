"""Edge tables: normal form, canonical edges, both directions, degree, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions.rules import look_up
from kinweave.operators.ranking import first_per_key

LOW, HIGH = "_low", "_high"


def is_known_type(rel_type: Column) -> Column:
    """True for a stored relation type or one of the inverse types."""
    return rel_type.isin(*vocab.RELATION_TYPES, *vocab.INVERSE_TYPES)


def is_directed(rel_type: Column) -> Column:
    """Whether a type has a direction; unknown types count as directed."""
    undirected = [t for t, (_, _, directed) in vocab.RELATION_TYPES.items() if not directed]
    return ~rel_type.isin(*undirected)


def type_label(rel_type: Column) -> Column:
    labels = {t: label for t, (label, _, _) in vocab.RELATION_TYPES.items()}
    return F.coalesce(look_up(labels, rel_type), rel_type)


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Turn inverse types round and drop unknown types."""
    given = F.trim("type")
    turned = given.isin(*vocab.INVERSE_TYPES)
    stored = F.coalesce(look_up(vocab.INVERSE_TYPES, given), given)
    return edges.filter(is_known_type(given)).withColumns({
        "source_id": F.when(turned, F.col("target_id")).otherwise(F.col("source_id")),
        "target_id": F.when(turned, F.col("source_id")).otherwise(F.col("target_id")),
        "type": stored,
    })


def with_pair_key(edges: DataFrame) -> DataFrame:
    """Add the ends in sorted order, the key that both directions share."""
    return edges.withColumns({
        LOW: F.least("source_id", "target_id"), HIGH: F.greatest("source_id", "target_id"),
    })


def canonical_edges(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One row per unordered pair and type, the one with the smallest id.

    Self-loops go, and so do edges with an end outside ``vertices``.
    """
    kept = edges.filter(F.col("source_id") != F.col("target_id"))
    if vertices is not None:
        ids = vertices.select("id")
        for end in ("source_id", "target_id"):
            kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    kept = kept.select(*edges.columns)
    return first_per_key(with_pair_key(kept), [LOW, HIGH, "type"], ["id"]).drop(LOW, HIGH)


def graph_snapshot(vertices: DataFrame, relationships: DataFrame) -> DataFrame:
    """The edges of the reviewed graph: approved only, canonical, both ends known."""
    return canonical_edges(relationships.filter(F.col("status") == "approved"), vertices)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: src, dst and the other columns.

    A generator rather than a union, which would compute the edges twice.
    """
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    forward = F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    backward = F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return edges.select(F.explode(F.array(forward, backward)).alias("_way"), *rest).select("_way.*", *rest)


def end_ids(edges: DataFrame) -> DataFrame:
    """The ids at the ends of edges, one row per end."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))


def neighbors(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs in both directions."""
    return both_ways(edges.select("source_id", "target_id")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Number of distinct neighbours of each connected vertex: id, degree."""
    return neighbors(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def exclude_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Drop candidates that exist already, whichever way round they are stored."""
    known = with_pair_key(existing.select("source_id", "target_id", "type")).select(LOW, HIGH, "type").distinct()
    return with_pair_key(candidates).join(known, [LOW, HIGH, "type"], "left_anti").select(*candidates.columns)
