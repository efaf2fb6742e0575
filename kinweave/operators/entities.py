"""Building entity tables and resolving names, ids and mentions to entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions.names import (
    bracket_case_form,
    build_aliases,
    infer_mythology,
    normalize_name,
    normalize_region,
)
from kinweave.functions.rules import blank_to_null
from kinweave.operators.edges import HIGH, LOW, is_directed, is_known_type, normalize_edges, with_pair_key
from kinweave.operators.ranking import first_per_key


def _text(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit("")))


def build_entities(raw: DataFrame, enriched: DataFrame, now: Column | None = None,
                   model: str = "deepseek-chat") -> DataFrame:
    """Entities from raw records, with what enrichment knows on top.

    The number in the raw id makes the id; records without one, or without a name, are left out. The
    column ``alias_list`` holds the names to index.
    """
    known = enriched.select(
        F.col("id").alias("raw_id"), F.lit(True).alias("is_enriched"),
        blank_to_null("region").alias("e_region"), blank_to_null("description").alias("e_description"),
        _text("mythology_background").alias("mythology_background"),
        _text("metadata.alignment").alias("alignment"), _text("metadata.gender").alias("gender"),
        "extra", F.col("aliases").alias("e_aliases"),
    )
    known = first_per_key(known, ["raw_id"], ["e_region", "e_description"])
    number = F.regexp_extract("raw_id", r"(\d+)", 1)
    joined = (
        raw.withColumnsRenamed({"id": "raw_id", "class": "raw_class"})
        .filter((number != "") & (F.coalesce(number.try_cast("long"), F.lit(0)) > 0) & (_text("name") != ""))
        .join(known, "raw_id", "left")
        .withColumns({"wiki_id": number.try_cast("long"), "raw_name": _text("name")})
    )
    region = F.coalesce("e_region", blank_to_null("region"), F.lit(""))
    inferred = infer_mythology(F.col("prototype"), F.col("raw_name"), region)
    told = F.nullif(normalize_region(F.col("e_region")), F.lit(""))
    is_new = F.col("is_enriched").isNotNull()
    built = joined.select(
        F.concat(F.lit("c"), "wiki_id").alias("id"), "wiki_id", F.col("raw_name").alias("name"),
        _text("raw_class").alias("class_name"), _text("prototype").alias("prototype"),
        F.nullif(F.when(F.col("e_region").isNotNull(), F.coalesce(told, inferred)).otherwise(inferred), F.lit(""))
        .alias("mythology"),
        F.coalesce("e_description", _text("description")).alias("description"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("mythology_background", "alignment", "gender")],
        _text("image_url").alias("image_url"), _text("detail_url").alias("detail_url"), "extra",
        F.when(F.col("e_region").isNotNull(), "llm").otherwise("rule").alias("myth_source"),
        F.when(is_new, now if now is not None else F.current_timestamp()).alias("enriched_at"),
        F.when(is_new, model).otherwise("").alias("enrich_model"),
        build_aliases(F.col("raw_name"), F.col("prototype"), F.col("e_aliases")).alias("alias_list"),
    )
    return first_per_key(built, ["id"], ["name", "class_name"])


def alias_table(entities: DataFrame) -> DataFrame:
    """One row per entity and alias, with its place in the list."""
    return entities.select("id", F.posexplode("alias_list").alias("position", "alias"))


def build_name_index(vertices: DataFrame, aliases: DataFrame, prototypes: bool = False) -> DataFrame:
    """Which entity a name means: name, id. Names beat prototypes beat aliases; then the smallest wiki_id."""
    listed = vertices.select("name", F.lit(0).alias("priority"), "wiki_id", "id")
    if prototypes:
        listed = listed.union(vertices.select("prototype", F.lit(1), "wiki_id", "id"))
    others = aliases.select("id", "alias").join(vertices.select("id", "wiki_id"), "id")
    listed = listed.union(others.select("alias", F.lit(2), "wiki_id", "id"))
    listed = listed.filter(F.nullif("name", F.lit("")).isNotNull())
    return first_per_key(listed, ["name"], ["priority", "wiki_id", "id"]).select("name", "id")


def name_ends(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Add source_id and target_id by name; NULL where a name is unknown."""
    found = raw
    for end in ("source", "target"):
        ids = index.select(F.col("name").alias(f"_{end}"), F.col("id").alias(f"{end}_id"))
        found = found.withColumn(f"_{end}", F.trim(f"{end}_name")).join(ids, f"_{end}", "left").drop(f"_{end}")
    return found


def resolve_edges(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Edges by name to edges by id: both names known, normal form, no self-loops, first of each pair.

    ``raw`` has source_name, target_name, relationship and seq, the place of the record in its file.
    """
    return resolve_ends(name_ends(raw, index))


def resolve_ends(named: DataFrame, keyed: bool = False) -> DataFrame:
    """``resolve_edges`` from what ``name_ends`` makes of the records; ``keyed`` keeps the pair key, for ``assign_status``."""
    found = named.filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    typed = normalize_edges(found.withColumn("type", F.col("relationship")))
    typed = typed.filter(F.col("source_id") != F.col("target_id")).drop("relationship", "source_name", "target_name")
    firsts = first_per_key(with_pair_key(typed), [LOW, HIGH, "type"], ["seq"])
    return firsts if keyed else firsts.drop(LOW, HIGH)


def resolution_stats(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Records read, skipped (unknown name or type, self-loop), repeated and added."""
    named = name_ends(raw, index)
    return resolution_figures(named, resolve_ends(named))


def resolution_figures(named: DataFrame, resolved: DataFrame) -> DataFrame:
    """``resolution_stats`` from what ``name_ends`` makes of the records, and the edges they came to."""
    found = named.withColumn("type", F.trim("relationship"))
    usable = (
        F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
        & F.coalesce(is_known_type(F.col("type")), F.lit(False)) & (F.col("source_id") != F.col("target_id"))
    )
    flagged = found.withColumn("usable", F.coalesce(usable, F.lit(False)))
    counted = flagged.agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("usable")).alias("skipped"))
    added = resolved.agg(F.count(F.lit(1)).alias("added"))
    rows = counted.unpivot([], counted.columns, "metric", "value").unionByName(
        added.unpivot([], ["added"], "metric", "value"))
    return rows


def assign_status(edges: DataFrame, previous: DataFrame) -> DataFrame:
    """Status, origin, confidence and direction of freshly resolved edges.

    A valid status of the record wins; else a record with a confidence takes the status its triple
    had in ``previous``, or waits for review; a record without one is approved. Both directions of a pair
    are looked up together, so edges that stand by pair key already stay where they are.
    """
    ends = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    along, against = (F.when((F.col("source_id") == F.col(LOW)) == F.lit(way), F.col("status")) for way in (True, False))
    remembered = with_pair_key(previous.select("source_id", "target_id", "type", "status").filter(ends)).groupBy(LOW, HIGH, "type").agg(
        F.max(along).alias("_along"), F.max(against).alias("_against"))
    keyed = edges if {LOW, HIGH} <= set(edges.columns) else with_pair_key(edges)
    had = F.when(ends, F.when(F.col("source_id") == F.col(LOW), F.col("_along")).otherwise(F.col("_against")))
    rated = F.col("confidence").isNotNull()
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "type", LOW, HIGH)]
    joined = keyed.join(remembered, [LOW, HIGH, "type"], "left").select("source_id", "target_id", "type", *rest, had.alias("_previous"))
    return joined.withColumns({
        "status": F.when(F.col("status").isin(*vocab.STATUSES), F.col("status"))
        .when(rated, F.coalesce("_previous", F.lit("pending"))).otherwise("approved"),
        "origin": F.when(F.col("origin").isin(*vocab.ORIGINS), F.col("origin"))
        .when(rated, "llm").otherwise("manual"),
        "confidence": F.coalesce("confidence", F.lit("verified")),
        "evidence": _text("evidence"),
        "directed": is_directed(F.col("type")),
    }).drop("_previous")


def merge_snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values that are not empty win; old ones survive where the new record has none."""
    columns = [c for c in new.columns if c != key]
    pairs = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns]).join(new, key, "full")
    merged = {}
    for c in columns:
        fresh = F.nullif(c, F.lit("")) if dict(new.dtypes)[c] == "string" else F.col(c)
        merged[c] = F.coalesce(fresh, f"_old_{c}")
    return pairs.withColumns(merged).select(*new.columns)


def match_entities(candidates: DataFrame, vertices: DataFrame, aliases: DataFrame,
                   folding: Mapping[str, str] | None = None, prefix: str = "wd:") -> DataFrame:
    """Entity of each candidate (seq, qid, label): same qid, else same normalised name, else a new one.

    New candidates with one name share the id of the first. ``matched_by`` says qid, name or new. A
    candidate whose label has no letters matches no name and shares its id with nobody.
    """
    by_qid = first_per_key(
        vertices.filter(F.col("wikidata_qid").isNotNull()).select(F.col("wikidata_qid").alias("qid"), "wiki_id",
                                                                  F.col("id").alias("qid_match")),
        ["qid"], ["wiki_id", "qid_match"],
    ).select("qid", "qid_match")
    names = build_name_index(
        vertices.select("id", "wiki_id", normalize_name(F.col("name"), folding).alias("name")),
        aliases.select("id", normalize_name(F.col("alias"), folding).alias("alias")),
    ).select(F.col("name").alias("key"), F.col("id").alias("name_match"))
    # Blank keys are null, so they join with nothing.
    keyed = candidates.withColumn("key", F.nullif(normalize_name(F.col("label"), folding), F.lit("")))
    found = keyed.join(by_qid, "qid", "left").join(names, "key", "left")
    open_ = F.col("qid_match").isNull() & F.col("name_match").isNull()
    created = first_per_key(
        found.filter(open_ & F.col("key").isNotNull()).select("key", "seq", F.concat(F.lit(prefix), "qid").alias("new_id")), ["key"], ["seq", "new_id"]
    ).select("key", "new_id")
    return found.join(created, "key", "left").select(
        *candidates.columns,
        F.coalesce("qid_match", "name_match", "new_id", F.concat(F.lit(prefix), "qid")).alias("entity_id"),
        F.when(F.col("qid_match").isNotNull(), "qid").when(F.col("name_match").isNotNull(), "name").otherwise("new")
        .alias("matched_by"),
    )


def resolve_mentions(mentions: DataFrame, vertices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entity of each mention (mention_id, text): id, name, alias, then name in bracket and case form.

    The first stage with a match decides; within a stage the smallest wiki_id. Unmatched mentions
    come back with a NULL entity_id.
    """
    given = mentions.select("mention_id", F.trim("text").alias("text"))
    ids = vertices.select("id", "wiki_id").distinct()
    as_id = (given.filter(F.col("text").rlike("^[cC][0-9]+$")).join(ids, F.lower("text") == F.col("id"))
             .select("mention_id", F.lit(0).alias("stage"), "wiki_id", F.col("id").alias("entity_id")))
    keyed = [
        (vertices.select(F.col("name").alias("k"), "wiki_id", "id"), F.col("text"), 1),
        (aliases.select("id", F.col("alias").alias("k")).join(vertices.select("id", "wiki_id"), "id")
         .select("k", "wiki_id", "id"), F.col("text"), 2),
        (vertices.select(bracket_case_form(F.col("name")).alias("k"), "wiki_id", "id"),
         F.when(~F.col("text").rlike(r"^\s*[（）〔〕\[\]()]"), bracket_case_form(F.col("text"))), 3),
    ]
    found = as_id
    for names, key, stage in keyed:
        # One row per name before the join, so a common name does not multiply the mentions.
        firsts = first_per_key(names, ["k"], ["wiki_id", "id"])
        hit = given.withColumn("k", key).join(firsts, "k")
        found = found.union(hit.select("mention_id", F.lit(stage), "wiki_id", F.col("id")))
    best = first_per_key(found, ["mention_id"], ["stage", "wiki_id", "entity_id"])
    return mentions.join(best.select("mention_id", "entity_id", "stage"), "mention_id", "left")


def merge_enrichment(vertices: DataFrame, results: DataFrame, now: Column | None = None, model: str = "") -> DataFrame:
    """Overwrite entity fields with the non-empty ones of ``results`` and mark the entity as enriched.

    ``results`` has id, region and any of description, mythology_background, alignment, gender.
    """
    fields = [c for c in ("description", "mythology_background", "alignment", "gender") if c in results.columns]
    given = first_per_key(
        results.select("id", blank_to_null("region").alias("_region"),
                       *[blank_to_null(c).alias(f"_{c}") for c in fields]),
        ["id"], ["_region", *[f"_{c}" for c in fields]])
    joined = vertices.join(given.withColumn("_done", F.lit(True)), "id", "left")
    told = F.nullif(normalize_region(F.col("_region")), F.lit(""))
    changed = {c: F.coalesce(f"_{c}", c) for c in fields if c in vertices.columns}
    changed["mythology"] = F.coalesce(F.when(F.col("_region").isNotNull(), told), "mythology")
    done = F.col("_done").isNotNull()
    if "myth_source" in vertices.columns:
        changed["myth_source"] = F.when(told.isNotNull() & F.col("_region").isNotNull(), "llm").otherwise(F.col("myth_source"))
    earlier = F.col("enriched_at") if "enriched_at" in vertices.columns else F.lit(None).cast("timestamp")
    changed["enriched_at"] = F.when(done, now if now is not None else F.current_timestamp()).otherwise(earlier)
    if model:
        before = F.col("enrich_model") if "enrich_model" in vertices.columns else F.lit("")
        changed["enrich_model"] = F.when(done, model).otherwise(before)
    return joined.withColumns(changed).drop("_region", "_done", *[f"_{c}" for c in fields])


def merge_aliases(aliases: DataFrame, vertices: DataFrame, results: DataFrame) -> DataFrame:
    """Old aliases and those of the results, once each: id, alias."""
    found = results.select("id", "aliases").join(vertices.select("id", "name", "prototype"), "id")
    added = found.select("id", F.explode(build_aliases(F.col("name"), F.col("prototype"), F.col("aliases"))).alias("alias"))
    return aliases.select("id", "alias").union(added).distinct()


def enrichment_todo(vertices: DataFrame, results: DataFrame) -> DataFrame:
    """Entities that have no result yet."""
    return vertices.join(results.select("id"), "id", "left_anti")


def stage_stats(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows of a stage carry each flag column: metric, value."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags])
    return counted.unpivot([], counted.columns, "metric", "value")
