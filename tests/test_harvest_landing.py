"""Landing a harvest: evidence, first-wins rows, ids written back, and a second landing that adds nothing."""

from kinweave.plans.harvest import add_rows, fill_gaps, land_exact_names, land_incarnations

FOUND = "seq int, proto string, qid string, label string, description string, record_kind string, medium string, work_kind string, entity_id string, matched_by string"
CHARACTERS = "id string, wiki_id int, name string, class_name string, mythology string, source string, wikidata_qid string"
EDGES = "source_id string, target_id string, type string"


def test_incarnations_land_once(spark):
    found = spark.createDataFrame([
        (1, "P", "Q1", "Arthur", None, "character", "acg", None, "c1", "name"),
        (2, "P", "Q2", "Arthur", "again", "character", "acg", None, "c1", "name"),
        (3, "P", "Q3", "Mab", "queen", "character", "other-media", None, "wd:Q3", "new"),
        (4, "R", "Q3", "Mab", "queen", "character", "other-media", None, "wd:Q3", "new"),
        (5, "R", "Q5", "Opera", None, "work", None, "stage", "ww:Q5", "new"),
        (6, "P", "Q6", "Kept", None, "character", "acg", None, "c2", "qid"),
    ], FOUND)
    prototypes = spark.createDataFrame([("wp:P", 0, "P name", "原型", "Celtic", "wikidata", "P"),
                                        ("wp:R", 0, "R", "原型", None, "wikidata", "R")], CHARACTERS)
    tables = {
        "characters": spark.createDataFrame([("c1", 1, "arthur", None, None, "own", None), ("c2", 2, "Kept", None, None, "own", "Q6")], CHARACTERS),
        "works": spark.createDataFrame([], "id string, name string, kind string"),
        "relationships": spark.createDataFrame([("c2", "wp:P", "DERIVED_FROM")], EDGES)}
    once = land_incarnations(found, prototypes, tables)
    qids = {r.id: (r.wikidata_qid, r.mythology) for r in once["characters"].collect()}
    assert qids == {"c1": ("Q1", None), "c2": ("Q6", None), "wp:P": ("P", "Celtic"), "wp:R": ("R", None), "wd:Q3": ("Q3", "Celtic")}
    assert [(r.id, r.kind, r.prototype_qid, r.description) for r in once["works"].collect()] == [("ww:Q5", "stage", "R", "")]
    edges = {(r.source_id, r.target_id): (r.directed, r.evidence) for r in once["relationships"].collect()}
    assert edges == {("c2", "wp:P"): (None, None), ("c1", "wp:P"): (True, "wikidata P144/P1074 → P"),
                     ("wd:Q3", "wp:P"): (True, "wikidata P144/P1074 → P"), ("wd:Q3", "wp:R"): (True, "wikidata P144/P1074 → R")}
    twice = land_incarnations(found, prototypes, once)
    for name, rows in once.items():
        assert sorted(map(str, twice[name].collect())) == sorted(map(str, rows.collect()))


def test_exact_names_land_once(spark):
    linked = spark.createDataFrame([
        ("wp:P", 7, "Lancer", "bg:7", "new", 2), ("wp:P", 9, "lancer", "bg:7", "new", 1), ("wp:P", 8, "Saber", "c1", "name", 1)],
        "prototype_id string, cand_id long, label string, entity_id string, matched_by string, term_no int")
    prototypes = spark.createDataFrame([("wp:P", "Norse")], "id string, mythology string")
    candidates = spark.createDataFrame([(7, "a"), (8, None), (9, None)], "cand_id long, summary string")
    subjects = spark.createDataFrame([(8, 0, 5, "Game", 4), (8, 1, 6, " ", 4)],
                                     "cand_id long, position int, subject_id long, subject_name string, subject_type int")
    tables = {"characters": spark.createDataFrame([("c1", 1, "Saber", None, None, "own", None)], CHARACTERS),
              "works": spark.createDataFrame([], "id string, name string"),
              "appearances": spark.createDataFrame([], "character_id string, work_id string"),
              "relationships": spark.createDataFrame([], EDGES)}
    once = land_exact_names(linked, prototypes, candidates, subjects, tables)
    assert {(r.id, r.name, r.mythology, r.bangumi_id, r.description) for r in once["characters"].collect()} == {
        ("c1", "Saber", None, 8, None), ("bg:7", "lancer", "Norse", 9, "")}
    assert {(r.source_id, r.evidence) for r in once["relationships"].collect()} == {
        ("bg:7", "bangumi 精确同名 lancer (bg:9)"), ("c1", "bangumi 精确同名 Saber (bg:8)")}
    assert [tuple(r) for r in once["appearances"].collect()] == [("c1", "bgw:5")]
    twice = land_exact_names(linked, prototypes, candidates, subjects, once)
    for name, rows in once.items():
        assert sorted(map(str, twice[name].collect())) == sorted(map(str, rows.collect()))


def test_nothing_to_land(spark):
    stored = spark.createDataFrame([("a", None), ("b", "x")], "id string, note string")
    none = stored.limit(0)
    assert sorted(map(tuple, add_rows(stored, none, ["id"]).collect())) == [("a", None), ("b", "x")]
    values = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", "q"), ("c", "w")], "id string, note string")
    assert sorted(map(tuple, fill_gaps(stored, values, "id", "note").collect())) == [("a", "y"), ("b", "x")]
