"""Questions: tagging, entity linking, retrieval context, profiles, facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions.rules import all_contained, look_up, rule_array
from kinweave.functions.text import reply_body
from kinweave.lineage import cut
from kinweave.operators.edges import (
    HIGH,
    LOW,
    both_ways,
    exclude_existing,
    is_directed,
    normalize_edges,
    type_label,
    with_pair_key,
)
from kinweave.operators.graph import context_subgraph
from kinweave.operators.ranking import cap_per_group, first_per_key
from kinweave.operators.search import bm25_search, contained_needles, hybrid_search, lexical_search

PART_BREAK = "[，。？！,.\\s、]+|(?:和|与|跟|对|对阵|VS|vs)"


def _contained(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Values of all contained keywords in order, repeats kept."""
    hits = F.filter(rule_array(pairs), lambda rule: F.contains(text, rule["keyword"]))
    return F.transform(hits, lambda rule: rule["value"])


def tag_queries(texts: DataFrame) -> DataFrame:
    """Filters that question texts (query_id, text) name by vocabulary words.

    Output: query_id, mythologies, types, classes, gender, only_related, explanation.
    """
    text = F.trim("text")
    cores = [(m, m.replace("神话", "").replace("教", "")) for m in vocab.MYTHOLOGIES]
    myth_rules = [(word, m) for m, core in cores for word in ((m, core) if len(core) >= 2 else (m,))]
    type_rules = [(word, t) for word, types in vocab.QUESTION_TYPE_KEYWORDS for t in types]
    class_rules = [(c.lower(), vocab.CLASS_SHORT_NAMES.get(c, c)) for c in (*vocab.CLASS_NAMES, *vocab.CLASS_SHORT_NAMES)]
    tagged = texts.select(
        "query_id",
        all_contained(text, myth_rules).alias("mythologies"),
        all_contained(text, type_rules).alias("types"),
        _contained(F.lower(text), class_rules).alias("classes"),
        F.when(text.rlike("女性|女主"), "女").when(text.rlike("男性|男主"), "男").alias("gender"),
        text.rlike("有关系|相关").alias("only_related"),
    )
    labels = {t: label for t, (label, _, _) in vocab.RELATION_TYPES.items()}

    def part(name: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}="), F.array_join(values, "/")))

    named = F.transform("types", lambda t: F.coalesce(look_up(labels, t), t))
    parts = F.concat_ws("；", part("体系", F.col("mythologies")), part("关系", named), part("职阶", F.col("classes")),
                        F.concat(F.lit("性别="), "gender"))
    found = F.when(parts == "", F.lit("未识别到过滤条件")).otherwise(parts)
    return tagged.withColumn("explanation", F.concat(F.lit("规则解析："), found))


def merge_filters(rules: DataFrame, others: DataFrame) -> DataFrame:
    """Tagged filters with those of another parser: the tagged ones win where they say something.

    ``others`` has the same columns plus search.
    """
    def filled(column: str, values: Column) -> Column:
        return F.when(F.size(column) > 0, F.col(column)).otherwise(F.coalesce(values, F.col(column)))

    theirs = others.select("query_id", *[F.col(c).alias(f"_{c}") for c in others.columns if c != "query_id"])
    joined = rules.join(theirs, "query_id", "left")
    return joined.select(
        "query_id", *[filled(c, F.col(f"_{c}")).alias(c) for c in ("mythologies", "types", "classes")],
        F.coalesce(F.nullif("gender", F.lit("")), F.nullif("_gender", F.lit(""))).alias("gender"),
        (F.col("only_related") | F.coalesce("_only_related", F.lit(False))).alias("only_related"),
        F.nullif("_search", F.lit("")).alias("search"),
        F.concat_ws("；", F.nullif("explanation", F.lit("")), F.nullif("_explanation", F.lit(""))).alias("explanation"),
    )


def parse_structured(replies: DataFrame, schema: str) -> DataFrame:
    """Model replies (reply_id, raw) as structs: reply_id, parsed, bad.

    Thinking blocks and code fences come off first; what then does not fit the schema is marked.
    """
    body = reply_body(F.col("raw"))
    parsed = F.from_json(body, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    landed = replies.select("reply_id", parsed.alias("parsed"))
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull()
    return landed.select("reply_id", F.col("parsed").dropFields("_corrupt_record").alias("parsed"), bad.alias("bad"))


def candidates_to_edges(candidates: DataFrame, index: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed relations by name (seq, source_name, target_name, relationship, ...) as pending edges."""
    found = candidates
    for end in ("source", "target"):
        ids = index.select(F.col("name").alias(f"{end}_key"), F.col("id").alias(f"{end}_id"))
        found = found.withColumn(f"{end}_key", F.trim(f"{end}_name")).join(ids, f"{end}_key")
    typed = normalize_edges(found.filter(F.col("source_id") != F.col("target_id")).withColumn("type", F.col("relationship")))
    firsts = first_per_key(
        with_pair_key(typed.select("source_id", "target_id", "type", "confidence", "evidence", "seq")),
        [LOW, HIGH, "type"], ["seq"]).drop(LOW, HIGH)
    given = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium")
    return exclude_existing(firsts, existing).select(
        "source_id", "target_id", "type", is_directed(F.col("type")).alias("directed"), given.alias("confidence"),
        F.substring(F.coalesce("evidence", F.lit("")), 1, 200).alias("evidence"), F.lit("llm").alias("origin"),
        F.lit("pending").alias("status"))


CITATIONS = "array<struct<id: string, name: string, relation: string>>"
#: Fixed value: the answer to a question without a known entity.
NO_ENTITY = "没有在问题中识别到已知角色。可以试试：'阿尔托莉雅和莫德雷德是什么关系？'"


def question_parts(questions: DataFrame) -> DataFrame:
    """Parts of questions between punctuation and conjunctions, question words taken out: question_id, pieces, part."""
    parts = F.split("text", PART_BREAK)
    cleaned = F.col("piece")
    for word in vocab.QUESTION_STOP_WORDS:
        cleaned = F.replace(cleaned, F.lit(word), F.lit(""))
    cleaned = F.regexp_replace(cleaned, "^[的?？!！。 ，,]+|[的?？!！。 ，,]+$", "")
    cut = questions.select("question_id", F.size(parts).alias("pieces"), F.explode(parts).alias("piece"))
    return cut.select("question_id", "pieces", cleaned.alias("part")).filter(F.length("part") >= 2)


def name_base(name: Column) -> Column:
    """Name without a bracketed variant."""
    return F.trim(F.substring_index(F.substring_index(name, "〔", 1), "(", 1))


def link_entities(questions: DataFrame, vertices: DataFrame, postings: DataFrame, top: int = 3, tokens: int | None = None,
                  texts: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Entities that questions (question_id, text) are about: question_id, entity_id, score, rank.

    A name or prototype in the text scores ten per character. The parts of the text are searched as
    well, two points for a good hit and one for a fair one; with ``tokens``, by so many tokens of each.
    With ``texts`` (doc_id, field, text), a part that finds nothing takes names that contain it; with
    ``semantic`` (query_id, id, score), the query being a part, nearest vectors count as well.
    Variants of one name count as the one with the smallest wiki_id.
    """
    names = vertices.select(F.col("name").alias("needle"), F.lit(0).alias("o"), "wiki_id", "id").union(
        vertices.select("prototype", F.lit(1), "wiki_id", "id")).filter(F.length("needle") >= 2)
    index = first_per_key(names, ["needle"], ["o", "wiki_id", "id"]).select("needle", "id")
    index = cut(index)
    named = cut(contained_needles(questions.select(F.col("question_id").alias("text_id"), "text"), index).join(
        index, "needle").groupBy(F.col("text_id").alias("question_id"), "id").agg(
        F.max(F.length("needle") * 10).alias("points")))
    # Without other parts, only questions that name no one are searched.
    parts = question_parts(questions)
    searched = parts.filter(F.col("pieces") > 1).unionByName(
        parts.filter(F.col("pieces") <= 1).join(named.select("question_id"), "question_id", "left_anti"))
    asked = searched.select(F.col("part").alias("query_id"), F.col("part").alias("text")).distinct()
    lexical = cut(bm25_search(asked, postings, limit=6, tokens=tokens) if texts is None
                  else lexical_search(asked, postings, texts, limit=6, tokens=tokens))
    if semantic is None:
        semantic = lexical.select("query_id", F.col("doc_id").alias("id"), "score").filter(F.lit(False))
    found = hybrid_search(lexical, semantic, 3).select(F.col("query_id").alias("part"), F.col("doc_id").alias("id"), "score")
    recalled = searched.join(found, "part").groupBy("question_id", "id").agg(
        F.sum(F.when(F.col("score") > 0.3, 2).otherwise(1)).alias("points"))
    scored = named.select("question_id", "id", F.col("points").cast("long")).unionByName(
        recalled.select("question_id", "id", "points")).groupBy("question_id", "id").agg(F.sum("points").alias("points"))
    based = scored.join(vertices.select("id", "wiki_id", name_base(F.col("name")).alias("base")), "id")
    merged = first_per_key(based, ["question_id", "base"], ["wiki_id", "id"])
    ranked = cap_per_group(merged, ["question_id"], [F.desc("points"), "wiki_id", "id"], top, rank="rank")
    return ranked.select("question_id", F.col("id").alias("entity_id"), F.col("points").alias("score"), "rank")


def _shown_neighbors(edges: DataFrame, ids: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """The first ``k`` edges of each entity, in edge order: id, nth, other_id, other_name, label, confidence."""
    seen = both_ways(edges.select("id", "source_id", "target_id", "type", "confidence")).withColumnRenamed("id", "edge_id")
    mine = seen.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    first = cap_per_group(mine, ["src"], ["edge_id", "dst"], k, rank="nth")
    return first.join(vertices.select(F.col("id").alias("dst"), F.col("name").alias("other_name")), "dst").select(
        F.col("src").alias("id"), "nth", F.col("dst").alias("other_id"), "other_name", "type",
        type_label(F.col("type")).alias("label"), "confidence")


def _question_facts(linked: DataFrame, vertices: DataFrame, edges: DataFrame, shown: int) -> DataFrame:
    """question_id, context, and all that is cited, as structs of id, name and relation."""
    near = _shown_neighbors(edges, linked.select(F.col("entity_id").alias("id")), vertices, shown)
    line = F.concat(F.lit("  —"), "label", F.lit("→ "), "other_name", F.lit("（置信度 "), "confidence", F.lit("）"))
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line"),
        F.struct(F.col("other_id").alias("id"), F.col("other_name").alias("name"), F.col("type").alias("relation")).alias("other")))).alias("n"))
    facts = linked.select("question_id", "rank", F.col("entity_id").alias("id")).join(
        vertices.select("id", "name", "mythology", "class_name", "description"), "id").join(lists, "id", "left")
    blank = F.lit("")
    head = F.concat(F.lit("◆ "), "name", F.lit("（"), F.coalesce(F.nullif("mythology", blank), F.lit("体系未知")), F.lit("｜"),
                    F.coalesce(F.nullif("class_name", blank), F.lit("职阶未知")), F.lit("）"))
    about = F.when(F.nullif("description", blank).isNotNull(), F.concat(F.lit("\n  "), F.substring("description", 1, 120)))
    relations = F.when(F.col("n").isNotNull(), F.concat(
        F.lit("\n"), F.array_join("n.line", "\n"),
        F.when(F.size("n") >= shown, F.lit("\n  …（更多关系见图谱）")).otherwise(blank),
    )).otherwise(F.lit("\n  （暂无已审核的角色间关系）"))
    texts = facts.select("question_id", "rank", F.concat(head, F.coalesce(about, blank), relations).alias("text"),
                         F.coalesce("n.other", F.array().cast(CITATIONS)).alias("cited"))
    # At most a few entities per question, so these lists are short.
    return texts.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "cited"))).alias("t")
    ).select("question_id", F.array_join("t.text", "\n").alias("context"),
             F.flatten("t.cited").alias("citations"))


def question_contexts(linked: DataFrame, vertices: DataFrame, edges: DataFrame, shown: int = 8) -> DataFrame:
    """What the graph says about the entities of each question: question_id, context, citations.

    Per entity a head line, its description and up to ``shown`` relations; at most 30 cited ids.
    """
    return _question_facts(linked, vertices, edges, shown).withColumn("citations", F.slice("citations.id", 1, 30))


def question_answers(questions: DataFrame, linked: DataFrame, vertices: DataFrame, edges: DataFrame, shown: int = 8,
                     cited: int | None = None) -> DataFrame:
    """A row for each question: question_id, context, citations (structs of id, name and relation).

    A question in which no entity was found, or whose entities are not among ``vertices``, gets the text
    that says so and cites nothing. With ``cited``, at most so many citations are listed.
    """
    facts = _question_facts(linked, vertices, edges, shown)
    listed = F.coalesce("citations", F.array().cast(CITATIONS))
    return questions.select("question_id").distinct().join(facts, "question_id", "left").select(
        "question_id", F.coalesce("context", F.lit(NO_ENTITY)).alias("context"),
        (listed if cited is None else F.slice(listed, 1, cited)).alias("citations"))


def question_subgraphs(linked: DataFrame, vertices: DataFrame, edges: DataFrame, cap: int = 60) -> DataFrame:
    """Vertices within one hop of each question's entities, at most ``cap``: question_id, id."""
    seeds = linked.select(F.col("question_id").alias("key"), F.col("entity_id").alias("id"))
    return context_subgraph(vertices, edges, seeds, hops=1, cap=cap).withColumnRenamed("key", "question_id")


def pair_profiles(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, allies: int = 4) -> DataFrame:
    """A card for each pair (a_id, b_id): the text and up to ``allies`` allies of either side."""
    ends = pairs.select(F.col("a_id").alias("id")).union(pairs.select("b_id"))
    friends = edges.filter(F.col("type").isin("ALLY_OF", "MASTER_OF"))
    near = _shown_neighbors(friends, ends, vertices, allies)
    named = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "other_name"))).alias("n")).select(
        "id", F.col("n.other_name").alias("allies"))
    card = vertices.join(named, "id", "left").select(
        "id", "name", F.concat(
            "name", F.lit("："), "class_name", F.lit("，"), F.coalesce(F.nullif("mythology", F.lit("")), F.lit("体系未知")),
            F.lit("，"), F.substring("description", 1, 80)).alias("line"),
        F.coalesce("allies", F.array().cast("array<string>")).alias("allies"))
    joined = pairs.select("a_id", "b_id")
    for side in ("a", "b"):
        joined = joined.join(card.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "name", "line", "allies")]), f"{side}_id")
    return joined.select("a_id", "b_id", F.format_string("⚔️ %s VS %s\n%s\n%s", "a_name", "b_name", "a_line", "b_line").alias("card"),
                         "a_allies", "b_allies")


def entity_facts(vertices: DataFrame) -> DataFrame:
    """Hints about each entity in a fixed order: id, facts. Empty fields give none."""
    def fact(column: str, text: Column) -> Column:
        return F.when(F.nullif(column, F.lit("")).isNotNull(), text)

    alignment = "alignment" if "alignment" in vertices.columns else None
    facts = [
        fact("class_name", F.concat(F.lit("职阶："), "class_name")),
        fact("mythology", F.concat(F.lit("神话体系："), "mythology")),
        fact("gender", F.concat(F.lit("性别："), "gender")),
        *([fact(alignment, F.concat(F.lit("阵营："), alignment))] if alignment else []),
        F.when(F.col("prototype") != F.col("name"), fact(
            "prototype", F.concat(F.lit("原型名字里含有「"), F.substring("prototype", 1, 1), F.lit("」字")))),
        fact("description", F.concat(F.lit("简介片段："), F.substring("description", 1, 50), F.lit("…"))),
    ]
    return vertices.select("id", F.array_compact(F.array(*facts)).alias("facts"))
