"""Landing what a harvest found in the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import harvest
from kinweave.operators.ranking import first_per_key


def add_rows(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with those of ``rows`` whose keys it has not got; columns that only one has are null in the other.

    Keys must be unique within ``rows``. Adding the same rows again changes nothing.
    """
    return stored.unionByName(rows.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def fill_gaps(stored: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``stored`` with ``column`` taken from ``values`` (key, column) where it is null; the least value of a key counts."""
    if column not in stored.columns:
        stored = stored.withColumn(column, F.lit(None).cast(values.schema[column].dataType))
    known = first_per_key(values.select(key, F.col(column).alias("_value")), [key], ["_value"])
    filled = stored.join(known, key, "left").withColumn(column, F.coalesce(column, "_value"))
    return filled.select(stored.columns)


def land_incarnations(found: DataFrame, prototypes: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``characters``, ``works`` and ``relationships`` after ``harvest_incarnations``; none is written here.

    ``prototypes`` are the nodes of ``link_prototypes``; they are stored too. A second landing of the
    same harvest adds nothing.
    """
    characters, works = harvest.incarnation_rows(found, prototypes.select(F.col("wikidata_qid").alias("qid"), "mythology"))
    stored = fill_gaps(tables["characters"], harvest.learned_qids(found, tables["characters"]), "id", "wikidata_qid")
    edges = harvest.incarnation_edges(found, tables["relationships"].select("source_id", "target_id", "type"))
    return {
        "characters": add_rows(add_rows(stored, prototypes, ["id"]), characters, ["id"]),
        "works": add_rows(tables["works"], works, ["id"]),
        "relationships": add_rows(tables["relationships"], edges, ["source_id", "target_id", "type"]),
    }


def land_exact_names(linked: DataFrame, prototypes: DataFrame, candidates: DataFrame, subjects: DataFrame,
                     tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``characters``, ``works``, ``appearances`` and ``relationships`` after ``link_by_exact_name``; as above."""
    characters, known = harvest.exact_name_rows(linked, prototypes, candidates)
    works, appearances = harvest.link_appearances(linked, subjects)
    edges = harvest.exact_name_edges(linked, tables["relationships"].select("source_id", "target_id", "type"))
    return {
        "characters": add_rows(fill_gaps(tables["characters"], known, "id", "bangumi_id"), characters, ["id"]),
        "works": add_rows(tables["works"], works.withColumn("source", F.lit("bangumi")), ["id"]),
        "appearances": add_rows(tables["appearances"], appearances, ["character_id", "work_id"]),
        "relationships": add_rows(tables["relationships"], edges, ["source_id", "target_id", "type"]),
    }
