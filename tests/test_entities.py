"""Names, resolution, review and round trips."""

import itertools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from kinweave.functions import names
from kinweave.operators import entities, review
from kinweave.plans.build import PREVIOUS, build_all
from kinweave.sources import readers, sinks


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column).collect()]


def test_name_keys(spark):
    texts = ["美狄亚〔Lily〕", "美狄亚（ＬＩＬＹ）", "阿蒂拉·匈", "恺撒", "Éowyn-Ō", None, "ｱｲﾄﾞﾙ", "éa"]
    keys = values(spark, texts, names.normalize_name(F.col("t")))
    assert keys == ["美狄亚lily", "美狄亚lily", "阿提拉匈", "凯撒", "eowyno", "", unicodedata.normalize("NFKC", "ｱｲﾄﾞﾙ"), "ea"]
    folded = values(spark, ["東方"], names.normalize_name(F.col("t"), {"東": "东"}))
    assert folded == ["东方"]


def test_scalar_rules(spark):
    assert values(spark, ["古希腊", "-", " 亚瑟王传说 ", "火星", None], names.normalize_region(F.col("t"))) == [
        "希腊神话", "", "不列颠神话", "火星", ""]
    assert values(spark, ["阿尔托莉雅（Lily）", "某某 · Alter Ego", "x·saber "], names.guess_prototype(F.col("t"))) == [
        "阿尔托莉雅", "某某", "x"]
    assert values(spark, ["日本", "カナ", "abc", None], names.has_cjk(F.col("t"))) == [True, True, False, False]
    inferred = values(spark, ["吉尔伽美什", "尼托克丽丝", "北欧的谁", "Bob"], names.infer_mythology(F.col("t"), F.lit(""), F.lit("")))
    assert inferred == ["美索不达米亚神话", "埃及神话", "北欧神话", ""]
    assert values(spark, ["Bob（x）"], names.build_aliases(F.col("t"), F.lit(" "), F.array(F.lit("Bob"), F.lit("B")))) == [
        ["Bob（x）", "Bob", "B"]]
    kinds = values(spark, ["video game character", "Anime", "fairy tale", "opera", "rock"], names.work_kind(F.col("t")))
    assert kinds == ["game", "anime", "literature", "stage", "other"]
    assert values(spark, ["video game character", "game", "film"], names.character_or_work(F.col("t"))) == ["character", None, "work"]


def test_name_index_order(spark):
    v = spark.createDataFrame([("c10", 10, "X", "P"), ("c2", 2, "X", "Q"), ("c3", 3, "Q", "")],
                              "id string, wiki_id int, name string, prototype string")
    a = spark.createDataFrame([("c10", "Q"), ("c10", "Z"), ("c3", "Z")], "id string, alias string")
    assert dict(entities.build_name_index(v, a).collect()) == {"X": "c2", "Q": "c3", "Z": "c3"}
    assert dict(entities.build_name_index(v, a, prototypes=True).collect()) == {"X": "c2", "Q": "c3", "P": "c10", "Z": "c3"}


def test_mentions_by_bracket_form(spark):
    v = spark.createDataFrame([("c1", 1, "美狄亚〔Lily〕"), ("c2", 2, "Bob"), ("c77", 77, "Ann")], "id string, wiki_id int, name string")
    a = spark.createDataFrame([("c2", "Bobby")], "id string, alias string")
    m = spark.createDataFrame([(1, "美狄亚(lily)"), (2, "Bobby"), (3, " c77 "), (4, "(lily)"), (5, "nobody")], "mention_id int, text string")
    found = {r["mention_id"]: (r["entity_id"], r["stage"]) for r in entities.resolve_mentions(m, v, a).collect()}
    assert found == {1: ("c1", 3), 2: ("c2", 2), 3: ("c77", 0), 4: (None, None), 5: (None, None)}


def fold(status, confidence, actions):
    """The review rules one decision at a time."""
    outcomes = []
    for action in actions:
        if action == "approve" and status == "pending":
            status, confidence = "approved", "verified"
            outcomes.append("approved")
        elif action == "reject":
            status = "rejected"
            outcomes.append("rejected")
        else:
            outcomes.append("skipped")
    return status, confidence, outcomes


def test_any_sequence_of_decisions(spark):
    cases = [(s, seq) for s in ("pending", "approved", "rejected") for n in range(4)
             for seq in itertools.product(("approve", "reject"), repeat=n)]
    table = spark.createDataFrame([(i, s, "low", "why") for i, (s, _) in enumerate(cases)],
                                  "id long, status string, confidence string, evidence string")
    rows = [(i, a, f"n{k}", k) for i, (_, seq) in enumerate(cases) for k, a in enumerate(seq)] + [(999, "approve", "n", 0)]
    random.Random(3).shuffle(rows)
    decisions = spark.createDataFrame(rows, "id long, action string, note string, seq int")
    after = {r["id"]: r for r in review.apply_decisions(table, decisions).collect()}
    outcomes = {(r["id"], r["seq"]): r["outcome"] for r in review.decision_outcomes(table, decisions).collect()}
    assert outcomes[(999, 0)] == "skipped"
    for i, (status, seq) in enumerate(cases):
        want, confidence, results = fold(status, "low", seq)
        assert (after[i]["status"], after[i]["confidence"]) == (want, confidence)
        assert [outcomes[(i, k)] for k in range(len(seq))] == results
        notes = [f"n{k}" for k, r in enumerate(results) if r != "skipped"]
        assert after[i]["evidence"] == "why" + "".join(review.NOTE_MARK + n for n in notes)


def test_many_notes_fill_the_evidence_exactly(spark):
    table = spark.createDataFrame([(1, "pending", "low", "e")], "id long, status string, confidence string, evidence string")
    decisions = spark.range(300).select(F.lit(1).cast("long").alias("id"), F.lit("reject").alias("action"),
                                        F.lit("x").alias("note"), F.col("id").alias("seq"))
    [row] = review.apply_decisions(table, decisions).collect()
    assert row["evidence"] == ("e" + (review.NOTE_MARK + "x") * 300)[:500]


def test_directed_types_block_one_direction_only(spark):
    known = spark.createDataFrame([("a", "b", "PARENT_OF"), ("a", "b", "ALLY_OF")], "source_id string, target_id string, type string")
    rows = [("b", "a", "PARENT_OF", "", "me", "2024-01-01 00:00:00"), ("b", "a", "ALLY_OF", "", "me", "2024-01-01 00:00:00")]
    new = spark.createDataFrame(rows, "source_id string, target_id string, type string, evidence string, contributor string, at string")
    taken = review.intake(new.withColumn("submitted_at", F.col("at").cast("timestamp")), known).collect()
    assert [(r["source_id"], r["type"], r["evidence"]) for r in taken] == [("b", "PARENT_OF", "用户 me 提交")]


def test_export_builds_the_same_graph(spark, tmp_path):
    raw = [("1", "Alpha", "K", "Alpha", "", "希腊", "first", ""), ("2", "Beta（x）", "K", "B", "", "", "", ""),
           ("0", "none", "", "", "", "", "", ""), ("3", " ", "", "", "", "", "", "")]
    raw = spark.createDataFrame(raw, readers.RAW_ENTITY)
    rel = spark.createDataFrame(
        [(0, "Alpha", "Beta", "STUDENT_OF", "high", "e", None, "approved"), (1, "Beta（x）", "Alpha", "MENTOR_OF", None, "", None, None),
         (2, "Alpha", "Alpha", "ALLY_OF", None, "", None, None)], f"seq int, {readers.RAW_EDGE}")
    none = readers.read_enriched(spark, str(tmp_path / "missing"))
    figures = dict(build_all(spark, raw, none, rel, str(tmp_path / "v1")).collect())
    assert figures == {"characters": 2, "enriched": 0, "records": 3, "skipped": 1, "added": 1}
    v, a, r = (spark.read.parquet(str(tmp_path / "v1" / t)) for t in ("entities", "aliases", "relationships"))
    sinks.write_roundtrip(v, a, r, str(tmp_path / "out"))
    enriched = spark.read.schema(readers.ENRICHED_ENTITY).json(str(tmp_path / "out/entities"))
    again = spark.read.schema(readers.RAW_EDGE).json(str(tmp_path / "out/relationships")).withColumn("seq", F.lit(0))
    build_all(spark, enriched.select(*raw.columns), enriched, again, str(tmp_path / "v2"))
    for name, columns in (("entities", ["id", "name", "class_name", "mythology", "description"]), ("aliases", ["id", "alias"]),
                          ("relationships", ["source_id", "target_id", "type", "status", "confidence", "evidence"])):
        first, second = (spark.read.parquet(str(tmp_path / v / name)).select(columns) for v in ("v1", "v2"))
        assert sorted(first.collect()) == sorted(second.collect()), name


def test_labels_without_letters_match_nothing(spark):
    from kinweave.operators.entities import match_entities

    candidates = spark.createDataFrame([(0, "Q1", ""), (1, "Q2", ""), (2, "Q3", "·"), (3, "Q4", "Ann"), (4, "Q5", "Ann")],
                                       "seq int, qid string, label string")
    vertices = spark.createDataFrame([("c1", 1, "Bob", None)], "id string, wiki_id int, name string, wikidata_qid string")
    aliases = spark.createDataFrame([("c1", "·")], "id string, alias string")
    got = {r.qid: r.entity_id for r in match_entities(candidates, vertices, aliases).collect()}
    assert got == {"Q1": "wd:Q1", "Q2": "wd:Q2", "Q3": "wd:Q3", "Q4": "wd:Q4", "Q5": "wd:Q4"}


def test_ids_in_mentions_must_exist(spark):
    from kinweave.operators.entities import resolve_mentions

    mentions = spark.createDataFrame([(1, "c999"), (2, "C1"), (3, "c1")], "mention_id int, text string")
    vertices = spark.createDataFrame([("c1", 1, "Bob")], "id string, wiki_id int, name string")
    aliases = spark.createDataFrame([], "id string, alias string")
    got = {r.mention_id: r.entity_id for r in resolve_mentions(mentions, vertices, aliases).collect()}
    assert got == {1: None, 2: "c1", 3: "c1"}


def test_a_repeated_approval_counts_once(spark):
    from kinweave.operators.review import decision_counts

    edges = spark.createDataFrame([(1, "pending")], "id int, status string")
    for schema, rows in (("id int, action string", [(1, "approve"), (1, "approve")]),
                         ("id int, action string, seq int", [(1, "approve", 5), (1, "approve", 5)])):
        got = {r.outcome: r.n for r in decision_counts(edges, spark.createDataFrame(rows, schema)).collect()}
        assert got == {"approved": 1, "skipped": 1}


def test_status_is_looked_up_where_the_edges_stand(spark):
    """Either direction of a pair has a status of its own, and records without an end none."""
    named = spark.createDataFrame([(1, "b", "a", "PARENT_OF", "high", None, None, ""), (2, "a", "c", "MENTOR_OF", "high", None, None, "")],
                                  "seq long, source_id string, target_id string, relationship string, confidence string, status string, origin string, evidence string")
    previous = spark.createDataFrame([("a", "b", "PARENT_OF", "rejected"), ("b", "a", "PARENT_OF", "approved"), (None, "a", "PARENT_OF", "rejected"),
                                      ("c", "a", "MENTOR_OF", "rejected"), ("a", None, "MENTOR_OF", "rejected")], PREVIOUS)
    keyed = entities.assign_status(entities.resolve_ends(named, keyed=True), previous)
    assert not re.search(r"hashpartitioning\(source_id", keyed._jdf.queryExecution().executedPlan().toString())
    plain = entities.assign_status(entities.resolve_ends(named), previous)
    assert keyed.columns == plain.columns and sorted(keyed.collect()) == sorted(plain.collect())
    assert {r["seq"]: r["status"] for r in keyed.collect()} == {1: "approved", 2: "pending"}
    loose = spark.createDataFrame([("a", "a", "ALLY_OF"), (None, "a", "ALLY_OF"), ("b", "a", None), ("b", "a", "ALLY_OF")], "source_id string, target_id string, type string")
    given = loose.selectExpr("*", "'high' AS confidence", "CAST(NULL AS STRING) AS status", "'' AS origin", "'' AS evidence")
    before = spark.createDataFrame([("a", "a", "ALLY_OF", "approved"), ("b", "a", "ALLY_OF", "rejected"), ("a", "b", "ALLY_OF", "approved"), (None, "a", "ALLY_OF", "x")], PREVIOUS)
    got = {(r["source_id"], r["target_id"], r["type"]): r["status"] for r in entities.assign_status(given, before).collect()}
    assert got == {("a", "a", "ALLY_OF"): "approved", (None, "a", "ALLY_OF"): "pending", ("b", "a", None): "pending", ("b", "a", "ALLY_OF"): "rejected"}
