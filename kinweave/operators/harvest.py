"""Linking entities to prototypes, relatives and works from harvested tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions.names import character_or_work, medium_of, name_variants, normalize_name, work_kind
from kinweave.functions.rules import look_up
from kinweave.lineage import cut, spread
from kinweave.operators.edges import HIGH, LOW, exclude_existing, is_directed, with_pair_key
from kinweave.operators.entities import match_entities
from kinweave.operators.ranking import cap_per_group, first_per_key, top_n

HISTORIC_BEFORE = 1900


def class_texts(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels and descriptions of each record's classes as one text: qid, class_text."""
    classes = claims.select("qid", F.posexplode("p31").alias("position", "class_qid"))
    named = classes.join(labels.select(
        F.col("qid").alias("class_qid"),
        F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"),
    ), "class_qid")
    return named.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t")).select(
        "qid", F.array_join("t.text", " ").alias("class_text"))


def classify_historic_or_mythic(records: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``is_prototype``: whether a record (qid, description) is a historic or mythic figure.

    A mythic class that is not a generic word decides, unless the class is a whole mythology. Else a
    strong word in the description counts, unless something generic shows. Else the birth year does,
    unless the description names a modern occupation.
    """
    classes = claims.select("qid", F.explode("p31").alias("class_qid")).distinct()
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("description", F.lit("")))
    known = labels.select(F.col("qid").alias("class_qid"), text.alias("text"))
    facts = classes.join(known, "class_qid").groupBy("qid").agg(
        F.bool_or(F.col("text").rlike(vocab.MYTHIC_CLASS)).alias("_mythic"),
        F.bool_or(F.col("text").rlike(vocab.GENERIC_CLASS)).alias("_generic"),
        F.bool_or(F.col("text").rlike(vocab.MYTH_SYSTEM)).alias("_system"),
    )
    births = claims.groupBy("qid").agg(F.min("birth_year").alias("_birth"))
    joined = records.join(facts, "qid", "left").join(births, "qid", "left")
    said = F.coalesce("description", F.lit(""))
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("_mythic", "_generic", "_system")}
    generic = flag["_generic"] | said.rlike(vocab.GENERIC_CLASS)
    historic = F.coalesce(F.col("_birth") < HISTORIC_BEFORE, F.lit(False)) & ~said.rlike(vocab.MODERN_OCCUPATION)
    verdict = (
        F.when(flag["_mythic"] & ~flag["_generic"], ~flag["_system"])
        .when(said.rlike(vocab.STRONG_MYTHIC) & ~generic, F.lit(True)).otherwise(historic)
    )
    return joined.withColumn("is_prototype", verdict).select(*records.columns, "is_prototype")


def _exact_hits(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``exact``: whether the label of a hit is a name of its character. ``keys`` is (char_id, key)."""
    keyed = hits.withColumn("key", normalize_name(F.col("label")))
    known = keys.distinct().withColumn("_known", F.lit(True))
    return keyed.join(known, ["char_id", "key"], "left").withColumn(
        "exact", F.coalesce("_known", F.lit(False))).drop("key", "_known")


def _targets(hits: DataFrame, claims: DataFrame, meta: DataFrame, labels: DataFrame) -> DataFrame:
    """The works and figures that hits are based on and that count as prototypes, in claim order."""
    based_on = claims.select("qid", F.posexplode(F.array_distinct(F.concat(
        F.coalesce("p144", F.array().cast("array<string>")), F.coalesce("p1074", F.array().cast("array<string>"))
    ))).alias("target_position", "target_qid"))
    named = hits.join(based_on, "qid").join(
        meta.select(F.col("qid").alias("target_qid"), F.col("label").alias("target_label"),
                    F.col("description").alias("target_description")), "target_qid", "left")
    asked = named.select(F.col("target_qid").alias("qid"), F.col("target_description").alias("description")).distinct()
    valid = classify_historic_or_mythic(asked, claims, labels).filter("is_prototype").select(
        F.col("qid").alias("target_qid"), F.coalesce("description", F.lit("")).alias("_said"))
    return named.withColumn("_said", F.coalesce("target_description", F.lit(""))).join(
        valid, ["target_qid", "_said"], "left_semi").drop("_said")


def rate_hits(chars: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits with ``exact``, whether the label is a name of the character, as a written table.

    Characters are spread before their names are spelled out, which takes long for each of them, and
    their table may be one small file.
    """
    named = spread(chars.select("char_id", "char_native", "char_name", "char_alt"), "char_id")
    variants = named.select("char_id", F.explode(name_variants(
        F.col("char_native"), F.col("char_name"), F.col("char_alt"))).alias("v"))
    return cut(_exact_hits(hits, variants.select("char_id", normalize_name(F.col("v.name")).alias("key"))))


def prototype_match(chars: DataFrame, hits: DataFrame, claims: DataFrame, meta: DataFrame,
                    labels: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """Prototype of each character: char_id, method, char_qid, prototype_qids, confidence, matched_name.

    Tier A: the first hit (by position) that carries the character's own name and is based on valid
    prototypes. Tier B: a hit that is a prototype itself, one with the exact name first. Every
    character gets a row. ``rated`` is what ``rate_hits`` makes of the hits, if it is at hand.
    """
    rated = rate_hits(chars, hits) if rated is None else rated
    targets = cut(_targets(rated.filter("exact").select("char_id", "position", "qid"), claims, meta, labels))
    chosen = first_per_key(targets.select("char_id", "position", "qid"), ["char_id"], ["position", "qid"])
    listed = targets.join(chosen, ["char_id", "position", "qid"], "left_semi").groupBy("char_id", "qid").agg(
        F.array_sort(F.collect_list(F.struct(
            "target_position", "target_qid", F.coalesce("target_label", "target_qid").alias("target_label")))).alias("t"))
    tier_a = listed.select(
        "char_id", F.lit("wikidata_structured").alias("method"), F.col("qid").alias("char_qid"),
        F.col("t.target_qid").alias("prototype_qids"), F.lit(1.0).alias("confidence"),
        F.array_join("t.target_label", " ⇐ ").alias("matched_name"))
    own = classify_historic_or_mythic(rated, claims, labels).filter("is_prototype")
    own = own.withColumn("confidence", F.when(F.col("exact"), 0.7).otherwise(0.5))
    best = first_per_key(own.select("char_id", "position", "qid", "label", "description", "exact", "confidence"),
                         ["char_id"], [-F.col("confidence"), "position", "qid"])
    tier_b = best.join(tier_a, "char_id", "left_anti").select(
        "char_id", F.when(F.col("exact"), "name_match_exact").otherwise("name_match_loose").alias("method"),
        F.lit(None).cast("string").alias("char_qid"), F.array("qid").alias("prototype_qids"), "confidence",
        F.concat("label", F.lit("（"), F.substring(F.coalesce("description", F.lit("")), 1, 30), F.lit("）"))
        .alias("matched_name"))
    matched = tier_a.unionByName(tier_b)
    return chars.select("char_id").join(matched, "char_id", "left").select(
        "char_id", F.coalesce("method", F.lit("unmatched")).alias("method"), "char_qid",
        F.coalesce("prototype_qids", F.array().cast("array<string>")).alias("prototype_qids"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("matched_name", F.lit("")).alias("matched_name"))


def match_report(matches: DataFrame, hits: DataFrame) -> DataFrame:
    """Characters per method with their share in percent, and those with any candidate: method, n, pct.

    Of the hits only char_id is read, so a written table of them, such as that of ``rate_hits``, will do.
    """
    reached = hits.select("char_id").distinct().withColumn("_hit", F.lit(True))
    counted = F.array_compact(F.array(
        F.lit("_total"), F.col("method"),
        F.when(F.col("method") != "unmatched", F.lit("matched_total")),
        F.when(F.col("_hit"), F.lit("any_candidate")),
    ))
    counts = (
        matches.select("char_id", "method").join(reached, "char_id", "left")
        .select(F.explode(counted).alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per method is left, so this window is a handful of rows.
    total = F.max(F.when(F.col("method") == "_total", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 1)).filter(F.col("method") != "_total")


def match_samples(matches: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` characters per method."""
    return cap_per_group(matches, ["method"], ["char_id"], n)


def resolve_prototypes(seeds: DataFrame, hits: DataFrame, claims: DataFrame, meta: DataFrame,
                       labels: DataFrame) -> DataFrame:
    """Prototype of each seed (char_id, char_name, alias): hits with an exact name first.

    A hit counts if it is a prototype of exactly that name, or else through what it is based on.
    """
    names = seeds.select("char_id", F.explode(F.array("char_name", "alias")).alias("name"))
    keys = names.filter(F.col("name").isNotNull()).select("char_id", normalize_name(F.col("name")).alias("key"))
    rated = cut(_exact_hits(hits, keys))
    direct = classify_historic_or_mythic(rated, claims, labels).filter(F.col("exact") & F.col("is_prototype")).select(
        "char_id", "exact", "position", F.lit(1).alias("path"), F.lit(0).alias("place"),
        F.col("qid").alias("prototype_qid"), F.lit(None).cast("string").alias("char_qid"),
        F.col("label").alias("prototype_label"))
    through = _targets(rated.select("char_id", "exact", "position", "qid"), claims, meta, labels).select(
        "char_id", "exact", "position", F.lit(2).alias("path"), F.col("target_position").alias("place"),
        F.col("target_qid").alias("prototype_qid"), F.col("qid").alias("char_qid"),
        F.coalesce("target_label", "target_qid").alias("prototype_label"))
    order: list[Column | str] = [(~F.col("exact")).alias("loose"), "position", "path", "place", "prototype_qid"]
    return first_per_key(direct.unionByName(through), ["char_id"], order).select(
        "char_id", "prototype_qid", "char_qid", "prototype_label")


def link_prototypes(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prototype nodes, and the DERIVED_FROM edges of their seeds.

    ``resolved`` has seq, char_id, prototype_qid, prototype_label and mythology; the first seed of a
    prototype names it.
    """
    firsts = first_per_key(
        resolved.select("prototype_qid", "seq", "char_id", "prototype_label", "mythology"),
        ["prototype_qid"], ["seq", "char_id"])
    nodes = firsts.select(
        F.concat(F.lit("wp:"), "prototype_qid").alias("id"), F.lit(0).alias("wiki_id"),
        F.coalesce(F.nullif("prototype_label", F.lit("")), "prototype_qid").alias("name"),
        F.lit(vocab.PROTOTYPE_CLASS).alias("class_name"), F.nullif("mythology", F.lit("")).alias("mythology"),
        F.lit("wikidata").alias("source"), F.col("prototype_qid").alias("wikidata_qid"))
    named = resolved.select("char_id", "prototype_qid").distinct().join(
        nodes.select(F.col("wikidata_qid").alias("prototype_qid"), "name"), "prototype_qid")
    edges = derived(named.select(
        F.col("char_id").alias("source_id"), F.concat(F.lit("wp:"), "prototype_qid").alias("target_id"),
        F.format_string(vocab.SEED_EVIDENCE, "name", "prototype_qid").alias("evidence")), "seed")
    return nodes, edges


def derived(ends: DataFrame, origin: str) -> DataFrame:
    """DERIVED_FROM edges, as they are stored, from ``source_id, target_id, evidence``."""
    return ends.select("source_id", "target_id", F.lit("DERIVED_FROM").alias("type"), F.lit(True).alias("directed"),
                       F.lit("verified").alias("confidence"), "evidence", F.lit(origin).alias("origin"),
                       F.lit("approved").alias("status"))


def harvest_incarnations(rows: DataFrame, texts: DataFrame, vertices: DataFrame, aliases: DataFrame,
                         per_prototype: int = 40, limit: int | None = None) -> DataFrame:
    """Characters and works found behind prototypes, with the ids they get.

    ``rows`` is (seq, proto, qid, label, description), ``texts`` the class text per qid. Rows that are
    neither character nor work do not count toward the cap; ``limit`` counts new characters and works
    only, and rows of known ones stay. Output adds record_kind, medium,
    work_kind, entity_id and matched_by.
    """
    judged = rows.join(texts, "qid", "left").withColumn("class_text", F.coalesce("class_text", F.lit("")))
    judged = judged.withColumn("record_kind", character_or_work(F.col("class_text"))).filter("record_kind IS NOT NULL")
    kept = cap_per_group(judged, ["proto"], ["seq", "qid"], per_prototype)
    found = match_entities(kept.filter(F.col("record_kind") == "character"), vertices, aliases)
    made = kept.filter(F.col("record_kind") == "work").withColumns({
        "entity_id": F.concat(F.lit("ww:"), "qid"), "matched_by": F.lit("new")})
    described = found.unionByName(made)
    if limit is not None:
        described = _first_new(described, ["seq", "qid"], limit)
    is_work = F.col("record_kind") == "work"
    return described.withColumns({
        "medium": F.when(~is_work, medium_of(F.col("class_text"), F.col("label"))),
        "work_kind": F.when(is_work, work_kind(F.col("class_text"))),
    }).drop("class_text")


def _first_new(found: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Rows of known entities, and of the first ``limit`` new ones."""
    fresh = F.col("matched_by") == "new"
    firsts = first_per_key(found.filter(fresh).select("entity_id", *order), ["entity_id"], order)
    chosen = top_n(firsts, order, limit).select("entity_id")
    return found.filter(~fresh).unionByName(found.filter(fresh).join(chosen, "entity_id", "left_semi").select(found.columns))


def incarnation_edges(found: DataFrame, existing: DataFrame) -> DataFrame:
    """DERIVED_FROM edges of harvested characters that are not known yet."""
    edges = found.filter(F.col("record_kind") == "character").select(
        F.col("entity_id").alias("source_id"), F.concat(F.lit("wp:"), "proto").alias("target_id"),
        F.format_string(vocab.INCARNATION_EVIDENCE, "proto").alias("evidence")).distinct()
    return derived(edges, "wikidata").join(existing, ["source_id", "target_id", "type"], "left_anti")


def incarnation_rows(found: DataFrame, prototypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the new characters and works of ``harvest_incarnations``; the first row of an id makes it.

    ``prototypes`` is (qid, mythology), with one row per qid. A character takes the mythology of its
    prototype, a work keeps the prototype itself.
    """
    fresh = found.filter(F.col("matched_by") == "new")
    firsts = first_per_key(
        fresh.select("entity_id", "seq", "qid", "proto", "record_kind", "label", "description", "medium", "work_kind"),
        ["entity_id"], ["seq", "qid", "proto"])
    of_prototype = prototypes.select(F.col("qid").alias("proto"), "mythology")
    characters = firsts.filter(F.col("record_kind") == "character").join(of_prototype, "proto", "left").select(
        F.col("entity_id").alias("id"), F.lit(0).alias("wiki_id"), F.col("label").alias("name"), "mythology",
        F.coalesce("description", F.lit("")).alias("description"), F.lit("wikidata").alias("source"),
        F.col("qid").alias("wikidata_qid"), "medium")
    works = firsts.filter(F.col("record_kind") == "work").select(
        F.col("entity_id").alias("id"), F.col("label").alias("name"), F.col("work_kind").alias("kind"),
        F.col("qid").alias("wikidata_qid"), F.col("proto").alias("prototype_qid"), F.lit("wikidata").alias("source"),
        F.coalesce("description", F.lit("")).alias("description"))
    return characters, works


def learned_qids(found: DataFrame, vertices: DataFrame) -> DataFrame:
    """Stored entities without a qid and the first one that the harvest found for them: id, wikidata_qid."""
    known = found.filter((F.col("record_kind") == "character") & (F.col("matched_by") != "new"))
    firsts = first_per_key(known.select(F.col("entity_id").alias("id"), "seq", "qid"), ["id"], ["seq", "qid"])
    open_ = vertices.filter(F.col("wikidata_qid").isNull()).select("id")
    return firsts.join(open_, "id", "left_semi").select("id", F.col("qid").alias("wikidata_qid"))


def search_names(prototypes: DataFrame, aliases: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` of each prototype's sorted names: id, term_no, name. Aliases have 2 to 30 characters."""
    usable = aliases.filter(F.length("alias").between(2, 30))
    named = prototypes.select("id", "name").union(
        prototypes.select("id", "qid").join(usable, "qid").select("id", F.col("alias").alias("name")))
    return cap_per_group(named.distinct(), ["id"], ["name"], n, rank="term_no")


def link_by_exact_name(prototypes: DataFrame, aliases: DataFrame, candidates: DataFrame, vertices: DataFrame,
                       vertex_aliases: DataFrame, per_prototype: int = 6, limit: int | None = None) -> DataFrame:
    """Outside characters that carry a name of a prototype: prototype_id, cand_id, label, entity_id, matched_by, term_no.

    ``candidates`` is (cand_id, name). An equi-join on the normalised name; per prototype the first
    ones by name, then id. So of the candidates of one name, no prototype takes more than the first
    ``per_prototype``, and the others stay out of the join.
    """
    terms = search_names(prototypes, aliases).withColumn("key", normalize_name(F.col("name")))
    terms = terms.groupBy("id", "key").agg(F.min("term_no").alias("term_no"))
    named = candidates.select("cand_id", F.col("name").alias("label"), normalize_name(F.col("name")).alias("key"))
    named = cap_per_group(named, ["key"], ["cand_id"], per_prototype)
    hits = terms.withColumnRenamed("id", "prototype_id").join(named, "key")
    picked = cap_per_group(hits, ["prototype_id"], ["term_no", "cand_id"], per_prototype)
    if limit is not None:
        picked = top_n(picked, ["prototype_id", "term_no", "cand_id"], limit)
    # The first taker of a name, by prototype and rank, gives new entities of that name their id.
    seq = F.struct("prototype_id", "term_no", "cand_id")
    named_new = picked.select("prototype_id", "cand_id", "label", seq.alias("seq"),
                              F.concat(F.lit("bg:"), "cand_id").alias("qid"))
    by_name_only = vertices.select("id", "wiki_id", "name", F.lit(None).cast("string").alias("wikidata_qid"))
    matched = match_entities(named_new, by_name_only, vertex_aliases, prefix="")
    return matched.select("prototype_id", "cand_id", "label", "entity_id", "matched_by", F.col("seq.term_no").alias("term_no"))


def exact_name_edges(linked: DataFrame, existing: DataFrame) -> DataFrame:
    """DERIVED_FROM edges of ``link_by_exact_name`` that are not known yet; the first candidate is the evidence."""
    firsts = first_per_key(linked.select("entity_id", "prototype_id", "term_no", "cand_id", "label"),
                           ["entity_id", "prototype_id"], ["term_no", "cand_id"])
    edges = firsts.select(
        F.col("entity_id").alias("source_id"), F.col("prototype_id").alias("target_id"),
        F.format_string(vocab.EXACT_NAME_EVIDENCE, "label", F.col("cand_id").cast("string")).alias("evidence"))
    return derived(edges, "bangumi").join(existing, ["source_id", "target_id", "type"], "left_anti")


def exact_name_rows(linked: DataFrame, prototypes: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of new characters, and (id, bangumi_id) of known ones; of several candidates the first counts.

    ``candidates`` may have a ``summary``, which becomes the description. A new character takes the
    mythology of the first prototype that names it.
    """
    firsts = first_per_key(linked.select("entity_id", "prototype_id", "term_no", "cand_id", "label", "matched_by"),
                           ["entity_id"], ["prototype_id", "term_no", "cand_id"])
    summary = F.col("summary") if "summary" in candidates.columns else F.lit(None).cast("string")
    told = candidates.select("cand_id", F.coalesce(summary, F.lit("")).alias("description")).dropDuplicates(["cand_id"])
    characters = firsts.filter(F.col("matched_by") == "new").join(
        prototypes.select(F.col("id").alias("prototype_id"), "mythology"), "prototype_id", "left").join(
        told, "cand_id", "left").select(
        F.col("entity_id").alias("id"), F.lit(0).alias("wiki_id"), F.col("label").alias("name"), "mythology",
        F.coalesce("description", F.lit("")).alias("description"), F.lit("bangumi").alias("source"),
        F.col("cand_id").alias("bangumi_id"))
    known = firsts.filter(F.col("matched_by") != "new").select(
        F.col("entity_id").alias("id"), F.col("cand_id").alias("bangumi_id"))
    return characters, known


def link_appearances(linked: DataFrame, subjects: DataFrame, each: int = 5) -> tuple[DataFrame, DataFrame]:
    """Works and distinct (character_id, work_id) pairs from the first subjects of each linked character.

    ``subjects`` is (cand_id, position, subject_id, subject_name, subject_type). Unnamed subjects take
    up a place among the first ones but make no work.
    """
    listed = cap_per_group(subjects, ["cand_id"], ["position", "subject_id"], each)
    listed = listed.filter(F.trim("subject_name") != "")
    pairs = linked.select("entity_id", "cand_id").distinct().join(listed, "cand_id").select(
        F.col("entity_id").alias("character_id"), F.concat(F.lit("bgw:"), "subject_id").alias("work_id"),
        F.trim("subject_name").alias("name"), "subject_type")
    kind = F.coalesce(look_up(vocab.SUBJECT_KINDS, F.col("subject_type")), F.lit("other"))
    works = first_per_key(pairs.select(F.col("work_id").alias("id"), "name", kind.alias("kind")), ["id"], ["name", "kind"])
    return works, pairs.select("character_id", "work_id").distinct()


def family_edges(vertices: DataFrame, props: DataFrame, meta: DataFrame, claims: DataFrame, labels: DataFrame,
                 existing: DataFrame, own_source: str, per_anchor: int = 15) -> tuple[DataFrame, DataFrame]:
    """New relatives and family edges from properties (seq, anchor_qid, rel, member_qid).

    Anchors are prototypes, mythic persons and entities of ``own_source`` that have a qid; each
    anchor's first ``per_anchor`` properties count. A relative must be an anchor, be stored already,
    or be a historic or mythic figure; it then takes the mythology of the first anchor that names it.
    """
    special = F.col("class_name").isin(vocab.PROTOTYPE_CLASS, vocab.MYTH_PERSON_CLASS) | (F.col("source") == own_source)
    anchors = first_per_key(
        vertices.filter(F.col("wikidata_qid").isNotNull() & special)
        .select(F.col("wikidata_qid").alias("anchor_qid"), "wiki_id", F.col("id").alias("anchor_id"),
                F.col("mythology").alias("anchor_mythology")),
        ["anchor_qid"], ["wiki_id", "anchor_id"])
    rows = cap_per_group(props.join(anchors, "anchor_qid"), ["anchor_qid"], ["seq", "member_qid", "rel"], per_anchor)
    unknown = rows.select("member_qid").distinct().join(
        vertices.select(F.col("wikidata_qid").alias("member_qid")), "member_qid", "left_anti")
    described = unknown.select(F.col("member_qid").alias("qid")).join(meta, "qid", "left")
    fitting = classify_historic_or_mythic(described, claims, labels).filter("is_prototype")
    first_anchor = rows.groupBy(F.col("member_qid").alias("qid")).agg(
        F.min_by("anchor_mythology", F.struct("seq", "anchor_qid", "rel")).alias("mythology"))
    members = fitting.join(first_anchor, "qid").select(
        F.concat(F.lit("wd:"), "qid").alias("id"), F.lit(0).alias("wiki_id"),
        F.coalesce(F.nullif("label", F.lit("")), "qid").alias("name"),
        F.lit(vocab.MYTH_PERSON_CLASS).alias("class_name"), "mythology", F.lit("wikidata").alias("source"),
        F.col("qid").alias("wikidata_qid"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"))
    stored = vertices.select("id").filter(F.col("id").startswith("wd:")).union(members.select("id")).distinct()
    member_ids = (
        rows.join(anchors.select(F.col("anchor_qid").alias("member_qid"), F.col("anchor_id").alias("_anchor")),
                  "member_qid", "left")
        .join(stored.select(F.col("id").alias("_stored"), F.substring("id", 4, 1_000_000).alias("member_qid")),
              "member_qid", "left")
        .withColumn("member_id", F.coalesce("_anchor", "_stored"))
        .filter(F.col("member_id").isNotNull() & (F.col("member_id") != F.col("anchor_id")))
    )
    types = {rel: t for rel, (t, _) in vocab.FAMILY_PROPERTIES.items()}
    from_anchor = [rel for rel, (_, anchor_first) in vocab.FAMILY_PROPERTIES.items() if anchor_first]
    outward = F.col("rel").isin(*from_anchor)
    edges = member_ids.filter(F.col("rel").isin(*types)).select(
        F.when(outward, F.col("anchor_id")).otherwise(F.col("member_id")).alias("source_id"),
        F.when(outward, F.col("member_id")).otherwise(F.col("anchor_id")).alias("target_id"),
        look_up(types, F.col("rel")).alias("type"), "seq", "anchor_qid", "rel")
    edges = first_per_key(with_pair_key(edges), [LOW, HIGH, "type"], ["seq", "anchor_qid", "rel"]).drop(LOW, HIGH)
    edges = exclude_existing(edges, existing).select(
        "source_id", "target_id", "type", is_directed(F.col("type")).alias("directed"), F.lit("verified").alias("confidence"),
        F.format_string(vocab.FAMILY_EVIDENCE, "rel").alias("evidence"), F.lit("wikidata").alias("origin"), F.lit("approved").alias("status"))
    return members, edges


def work_relation_edges(relations: DataFrame, works: DataFrame,
                        existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New works and work relations from (seq, work_id, relation_type, media_id, title, format).

    A prequel is stored as the sequel of the other work. A pair counts once per type, whichever way
    round, and not at all if it is known.
    """
    kept = relations.filter(F.col("relation_type").isin(*vocab.WORK_RELATIONS) & F.col("media_id").isNotNull())
    kept = kept.withColumn("other_id", F.concat(F.lit("alw:"), "media_id"))
    firsts = first_per_key(kept.select("other_id", "seq", "media_id", "title", "format"), ["other_id"], ["seq", "media_id"])
    new_works = firsts.join(works.select(F.col("id").alias("other_id")), "other_id", "left_anti").select(
        F.col("other_id").alias("id"),
        F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("al:"), "media_id")).alias("name"),
        F.coalesce(look_up(vocab.FORMAT_KINDS, F.col("format")), F.lit("other")).alias("kind"),
        F.col("media_id").alias("anilist_id"), F.lit("anilist").alias("source"))
    turned = F.col("relation_type") == "PREQUEL"
    edges = kept.select(
        F.when(turned, F.col("other_id")).otherwise(F.col("work_id")).alias("source_id"),
        F.when(turned, F.col("work_id")).otherwise(F.col("other_id")).alias("target_id"),
        F.when(turned, "SEQUEL").otherwise(F.col("relation_type")).alias("type"), "seq")
    edges = first_per_key(with_pair_key(edges), [LOW, HIGH, "type"], ["seq", "source_id"]).drop(LOW, HIGH)
    known = existing.select("source_id", "target_id", F.col("relation_type").alias("type"))
    return new_works, exclude_existing(edges, known).select(
        "source_id", "target_id", F.col("type").alias("relation_type"))
