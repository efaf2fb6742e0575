"""Quality figures, distributions, prototype overviews and selection profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.lineage import cut
from kinweave.operators.edges import end_ids
from kinweave.operators.ranking import cap_per_group

#: Rows of selections that a task holds, whatever the number of partitions is set to.
TASK_ROWS = 500_000


def _missing(column: str):
    return F.nullif(column, F.lit("")).isNull()


def quality_stats(vertices: DataFrame, relationships: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One figure per row: metric, value."""
    enriched = F.count_if(F.col("enriched_at").isNotNull()) if "enriched_at" in vertices.columns else F.lit(0)
    of_vertices = vertices.agg(
        F.count(F.lit(1)).alias("characters"), enriched.cast("long").alias("enriched"),
        F.count_if(_missing("mythology")).alias("missing_mythology"),
        F.count_if(_missing("description")).alias("missing_description"),
    )
    of_edges = relationships.agg(
        F.count(F.lit(1)).alias("relationships"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    orphans = vertices.select("id").join(end_ids(snapshot), "id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_nodes"))
    result = None
    for figures in (of_vertices, of_edges, orphans):
        rows = figures.unpivot([], figures.columns, "metric", "value")
        result = rows if result is None else result.unionByName(rows)
    return result


def distributions(vertices: DataFrame, relationships: DataFrame) -> DataFrame:
    """Counts by relation type, confidence, origin, mythology and class: dimension, value, n.

    Edges count whatever their status. All dimensions of a table are counted in one pass.
    """
    def counted(df: DataFrame, dimensions: dict) -> DataFrame:
        entries = F.explode(F.array(*[
            F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in dimensions.items()
        ]))
        return df.select(entries.alias("e")).select("e.*").filter(F.col("value").isNotNull()).groupBy(
            "dimension", "value").agg(F.count(F.lit(1)).alias("n"))

    edges = counted(relationships, {c: F.col(c) for c in ("type", "confidence", "origin")})
    nodes = counted(vertices, {
        "mythology": F.coalesce(F.nullif("mythology", F.lit("")), F.lit(vocab.UNGROUPED)),
        "class": F.nullif("class_name", F.lit("")),
    })
    return edges.unionByName(nodes)


def _incarnations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(prototype_id, entity columns) of each entity derived from a prototype."""
    prototypes = vertices.filter(F.col("class_name") == vocab.PROTOTYPE_CLASS).select(F.col("id").alias("prototype_id"))
    derived = edges.filter(F.col("type") == "DERIVED_FROM").select(
        F.col("source_id").alias("id"), F.col("target_id").alias("prototype_id"))
    return derived.join(prototypes, "prototype_id", "left_semi").join(vertices, "id")


def first_works(appearances: DataFrame, works: DataFrame, k: int) -> DataFrame:
    """Names of the first ``k`` works of each entity, in work id order: id, works."""
    named = appearances.join(works.select(F.col("id").alias("work_id"), "name"), "work_id")
    first = cap_per_group(named.select(F.col("character_id").alias("id"), "work_id", "name"), ["id"], ["work_id"], k)
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("work_id", "name"))).alias("w")).select(
        "id", F.col("w.name").alias("works"))


def prototype_radar(vertices: DataFrame, edges: DataFrame, works: DataFrame, own_source: str) -> DataFrame:
    """Each prototype with its numbers of own and other incarnations and of works, largest first.

    The lists behind the numbers are tables of their own: ``prototype_incarnations`` and the works
    with the prototype's qid. A prototype may have any number of them.
    """
    counts = _incarnations(vertices, edges).groupBy("prototype_id").agg(
        F.count_if(F.col("source") == own_source).alias("own"),
        F.count_if(F.coalesce(F.col("source") != own_source, F.lit(True))).alias("others"),
    )
    by_qid = works.filter(F.col("prototype_qid").isNotNull()).groupBy("prototype_qid").agg(
        F.count(F.lit(1)).alias("works"))
    listed = vertices.filter(F.col("class_name") == vocab.PROTOTYPE_CLASS)
    zero = F.lit(0).cast("long")
    return (
        listed.join(counts, F.col("id") == F.col("prototype_id"), "left")
        .join(by_qid, F.col("wikidata_qid") == F.col("prototype_qid"), "left")
        .select("id", "name", F.coalesce("mythology", F.lit("")).alias("mythology"),
                F.coalesce("own", zero).alias("own"), F.coalesce("others", zero).alias("others"),
                F.coalesce("works", zero).alias("works"))
        .withColumn("incarnations", F.col("own") + F.col("others"))
        .orderBy(F.desc(F.col("incarnations") + F.col("works")), "id")
    )


def prototype_incarnations(vertices: DataFrame, edges: DataFrame, appearances: DataFrame, works: DataFrame,
                           own_source: str, works_each: int = 3) -> DataFrame:
    """One row per incarnation, with its first works: the lists of the radar."""
    rows = _incarnations(vertices, edges).join(first_works(appearances, works, works_each), "id", "left")
    own = F.coalesce(F.col("source") == own_source, F.lit(False))
    return rows.select("prototype_id", "id", "name", own.alias("own"), "class_name",
                       F.substring("description", 1, 80).alias("description"),
                       F.coalesce("works", F.array().cast("array<string>")).alias("works"))


def filter_prototypes(radar: DataFrame, incarnations: DataFrame, works: DataFrame, keyword: str) -> DataFrame:
    """Prototypes whose name, mythology, own incarnations or works contain the keyword."""
    text = keyword.strip().lower()
    if not text:
        return radar
    by_name = incarnations.filter(F.col("own") & F.contains(F.lower("name"), F.lit(text))).select(
        F.col("prototype_id").alias("id"))
    by_work = works.filter(F.contains(F.lower("name"), F.lit(text))).select(
        F.concat(F.lit("wp:"), "prototype_qid").alias("id"))
    itself = radar.filter(
        F.contains(F.lower("name"), F.lit(text)) | F.contains("mythology", F.lit(text))).select("id")
    return radar.join(by_name.union(by_work).union(itself), "id", "left_semi")


def evolution_matrix(vertices: DataFrame, edges: DataFrame, appearances: DataFrame, works: DataFrame,
                     own_source: str, works_each: int = 5) -> DataFrame:
    """Attributes of all incarnations of each prototype; sort_no 0 marks the own source.

    Rows of one prototype read in the order of sort_no, name, id.
    """
    rows = _incarnations(vertices, edges).join(first_works(appearances, works, works_each), "id", "left")
    return rows.select(
        "prototype_id", F.when(F.col("source") == own_source, 0).otherwise(1).alias("sort_no"), "id", "name", "source",
        "class_name", "gender", F.coalesce("mythology", F.lit("")).alias("mythology"),
        F.coalesce("works", F.array().cast("array<string>")).alias("works"))


def _by_size(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a written table, and how many tasks its rows are dealt out to: more rows, more tasks."""
    rows = cut(df)
    return rows, max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def _selected(selections: DataFrame, vertices: DataFrame) -> tuple[DataFrame, int]:
    """Each entity of a selection once, with what is known of it, and the number of tasks for so many."""
    rows, parts = _by_size(selections.select("user_id", "id"))
    mythology = F.coalesce(F.nullif("mythology", F.lit("")), F.lit(vocab.UNGROUPED)).alias("mythology")
    return rows.repartition(parts, "id").distinct().join(vertices.select("id", "class_name", mythology), "id"), parts


def selection_prototypes(selections: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of each user's selection per prototype: user_id, prototype_id, members.

    An entity counts for one prototype, the one of its last DERIVED_FROM edge.
    """
    chosen, parts = _selected(selections, vertices)
    return _members(chosen, parts, vertices, edges)


def _members(chosen: DataFrame, parts: int, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    prototypes = vertices.filter(F.col("class_name") == vocab.PROTOTYPE_CLASS).select(F.col("id").alias("target_id"))
    derived = edges.filter(F.col("type") == "DERIVED_FROM").join(prototypes, "target_id", "left_semi")
    of_entity = derived.groupBy(F.col("source_id").alias("id")).agg(F.max_by("target_id", "id").alias("prototype_id"))
    members = chosen.select("user_id", "id").join(of_entity, "id").select("user_id", "prototype_id")
    return members.repartition(parts, "user_id").groupBy("user_id", "prototype_id").agg(F.count(F.lit(1)).alias("members"))


def selection_profile(selections: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Profile of each user's selection.

    total, mythologies, diversity (distinct mythologies per selected entity), top_classes (three
    commonest), shared_prototypes (prototypes with two members or more), guardian (the prototype
    with most members; ties go to the smaller id) and its number of members.
    """
    chosen, parts = _selected(selections, vertices)
    chosen = cut(chosen)
    by_group = chosen.select("user_id", "mythology").repartition(parts, "user_id").groupBy("user_id", "mythology").agg(F.count(F.lit(1)).alias("n"))
    totals = by_group.groupBy("user_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("mythologies"))
    classes = chosen.filter(F.nullif("class_name", F.lit("")).isNotNull()).select("user_id", "class_name")
    by_class = classes.repartition(parts, "user_id").groupBy("user_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    top = cap_per_group(by_class, ["user_id"], [F.desc("n"), "class_name"], 3)
    top = top.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "class_name"))).alias("t")
    ).select("user_id", F.col("t.class_name").alias("top_classes"))
    shared = _members(chosen.repartition(parts, "id"), parts, vertices, edges).groupBy("user_id").agg(
        F.count_if(F.col("members") >= 2).alias("shared_prototypes"),
        F.min_by("prototype_id", F.struct((-F.col("members")).alias("m"), "prototype_id")).alias("guardian"),
        F.max("members").alias("guardian_members"),
    )
    return (
        totals.join(top, "user_id", "left").join(shared, "user_id", "left")
        .select("user_id", "total", "mythologies",
                F.round(F.col("mythologies") / F.col("total"), 2).alias("diversity"), "top_classes",
                F.coalesce("shared_prototypes", F.lit(0).cast("long")).alias("shared_prototypes"),
                "guardian", "guardian_members")
    )


def selection_distribution(selections: DataFrame, vertices: DataFrame) -> DataFrame:
    """Selected entities per user and mythology."""
    chosen, parts = _selected(selections, vertices)
    return chosen.select("user_id", "mythology").repartition(parts, "user_id").groupBy("user_id", "mythology").agg(F.count(F.lit(1)).alias("n"))
