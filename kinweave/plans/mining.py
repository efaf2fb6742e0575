"""From pages to relation candidates, with the stages that later ones read more than once written down."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.operators.mining import (
    build_dictionary,
    comention_sentences,
    learn_triggers,
    mention_pairs,
    page_sections,
    page_sentences,
    relation_candidates,
    seed_pairs,
    tag_entities,
    template_candidates,
)


def numbered_sentences(pages: DataFrame) -> DataFrame:
    """Sentences of the pages (page_id, title, text) under an id that sorts like their places."""
    found = page_sentences(page_sections(pages))
    return found.withColumn("sentence_id", F.struct("page_id", "section_no", "sentence_no"))


def mined_pairs(sentences: DataFrame, vertices: DataFrame, aliases: DataFrame,
                folding: Mapping[str, str] | None = None) -> DataFrame:
    """Pairs of entities named in one sentence, as a written table; ``folding`` holds for every key."""
    kept = cut(sentences.select("sentence_id", "title", "text"))
    tags = tag_entities(kept, build_dictionary(vertices, aliases, folding), folding)
    return cut(mention_pairs(comention_sentences(kept, tags, folding)))


def mine_relations(pairs: DataFrame, vertices: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """All new candidates of the pairs, symmetric and directed."""
    names = vertices.select("name").union(aliases.select("alias"))
    triggers = learn_triggers(pairs, seed_pairs(vertices, edges), names)
    symmetric = relation_candidates(pairs, triggers, edges)
    directed = template_candidates(pairs, edges)
    return symmetric.unionByName(directed.select(*symmetric.columns))
