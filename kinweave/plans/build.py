"""From raw records to a reviewed graph, as one version of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.operators.edges import graph_snapshot
from kinweave.operators.entities import (
    alias_table,
    assign_status,
    build_entities,
    build_name_index,
    name_ends,
    resolution_figures,
    resolve_ends,
)
from kinweave.operators.search import build_postings, field_texts

PREVIOUS = "source_id string, target_id string, type string, status string"


def build_all(spark: SparkSession, raw: DataFrame, enriched: DataFrame, raw_edges: DataFrame, out: str,
              previous: DataFrame | None = None) -> DataFrame:
    """Write entities, aliases, relationships, snapshot and postings under ``out``; return the figures.

    ``out`` names a version; earlier versions stay as they are. ``previous`` is the relationship table
    whose review results are carried over. Each table is read back by the steps after it, and the ends
    of the records are looked up once, for the relationships and the figures.
    """
    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    entities = save(build_entities(raw, enriched), "entities")
    aliases = save(alias_table(entities), "aliases")
    index = save(build_name_index(entities, aliases), "name_index")
    remembered = previous if previous is not None else spark.createDataFrame([], PREVIOUS)
    named = cut(name_ends(raw_edges, index).drop("source_name", "target_name"))
    resolved = assign_status(resolve_ends(named, keyed=True), remembered)
    relationships = save(resolved.withColumnRenamed("seq", "id"), "relationships")
    save(graph_snapshot(entities, relationships), "snapshot")
    save(build_postings(field_texts(entities, aliases)), "postings")
    made = entities.agg(F.count(F.lit(1)).alias("characters"), F.count("enriched_at").alias("enriched"))
    figures = made.unpivot([], made.columns, "metric", "value")
    return figures.unionByName(resolution_figures(named, relationships))
