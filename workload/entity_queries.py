"""Entity building, resolution, review and harvest operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import names
from kinweave.operators import edges, entities, harvest, review
from kinweave.plans.harvest import land_incarnations
from workload.registry import query
from workload.views import view

SEPARATORS_SQL = names.SEPARATORS.replace("'", "''")


def name_key(expression: str) -> str:
    """SQL for the normalised name of text without compatibility characters."""
    folds = names.SPELLING_VARIANTS
    return (f"translate(lower(translate({expression}, '{SEPARATORS_SQL}', '')), "
            f"'{''.join(folds)}', '{''.join(folds.values())}')")


# --- scalar rules --------------------------------------------------------------------------------

@query(f"""SELECT p_partkey, {name_key("concat(p_name, '·', p_brand, '（', p_type, '）')")} AS key,
                  lower(concat(p_name, '(', p_brand, ')')) AS guess_key,
                  concat(p_name, ' ', p_partkey) AS prototype, false AS cjk, trim(p_name) AS bare FROM part""")
def name_forms(spark, sf):
    part = view(spark, sf, "part")
    return part.select(
        "p_partkey",
        names.normalize_name(F.concat("p_name", F.lit("·"), "p_brand", F.lit("（"), "p_type", F.lit("）"))).alias("key"),
        names.bracket_case_form(F.concat("p_name", F.lit("（"), "p_brand", F.lit("）"))).alias("guess_key"),
        names.guess_prototype(F.concat("p_name", F.lit(" "), "p_partkey", F.lit("（x） · Alter Ego"))).alias("prototype"),
        names.has_cjk(F.col("p_name")).alias("cjk"),
        names.strip_brackets(F.concat("p_name", F.lit("(x)"))).alias("bare"),
    )


@query("""SELECT label, CASE label WHEN 'video game' THEN 'game' WHEN 'film' THEN 'film' WHEN 'opera' THEN 'stage'
                             ELSE 'other' END AS kind,
                 CASE WHEN label = 'fictional character' THEN 'character'
                      WHEN label IN ('video game', 'film', 'opera') THEN 'work' END AS record_kind, count(*) AS n
          FROM fx_claims c JOIN fx_labels l ON l.qid = c.class_1 GROUP BY ALL""", ("fx_claims", "fx_labels"))
def work_kinds(spark, sf):
    named = view(spark, sf, "fx_claims").join(
        view(spark, sf, "fx_labels").select(F.col("qid").alias("class_1"), "label"), "class_1")
    return named.select("label", names.work_kind(F.col("label")).alias("kind"),
                        names.character_or_work(F.col("label")).alias("record_kind")).groupBy(
        "label", "kind", "record_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, concat(p_name, '/ja|', p_name, ' ', p_brand, '/en|', p_type, '/en') AS variants FROM part""")
def name_variants(spark, sf):
    part = view(spark, sf, "part")
    variants = names.name_variants(
        F.col("p_name"), F.concat("p_name", F.lit(" "), "p_brand"),
        F.array(F.upper("p_name"), F.lit("x"), "p_type", F.concat("p_name", F.lit("-"), "p_brand")))
    pairs = F.transform(variants, lambda v: F.concat_ws("/", v["name"], v["lang"]))
    return part.select("p_partkey", F.array_join(pairs, "|").alias("variants"))


# --- entity build --------------------------------------------------------------------------------

def _enriched(spark, sf):
    return view(spark, sf, "fx_enriched").select(
        "id", "region", "description", F.lit("").alias("mythology_background"),
        F.struct(F.lit("").alias("alignment"), "gender").alias("metadata"),
        F.create_map(F.lit("k"), F.lit("v")).alias("extra"), F.array("extra_alias").alias("aliases"))


def _built(spark, sf):
    return entities.build_entities(view(spark, sf, "fx_raw_entities"), _enriched(spark, sf))


@query("""WITH j AS (SELECT r.*, e.region AS e_region, e.description AS e_description, e.gender,
                            e.id IS NOT NULL AS is_enriched, CAST(replace(r.id, 'No.', '') AS BIGINT) AS wiki_id, trim(r.name) AS full_name
                     FROM fx_raw_entities r LEFT JOIN fx_enriched e ON r.id = e.id),
  k AS (SELECT *, CASE coalesce(nullif(e_region, ''), region) WHEN '希腊' THEN '希腊神话' WHEN '古代日本' THEN '日本神话'
                       WHEN '北欧' THEN '北欧神话' ELSE CASE WHEN contains(name, '阿周那') THEN '印度神话' END END AS inferred FROM j)
  SELECT concat('c', wiki_id) AS id, wiki_id, full_name AS name, class AS class_name, prototype,
         CASE WHEN e_region = '北欧' THEN '北欧神话' ELSE inferred END AS mythology,
         coalesce(nullif(e_description, ''), trim(description)) AS description, coalesce(gender, '') AS gender,
         CASE WHEN e_region <> '' THEN 'llm' ELSE 'rule' END AS myth_source, is_enriched,
         CASE WHEN is_enriched THEN 'deepseek-chat' ELSE '' END AS enrich_model
  FROM k WHERE wiki_id > 0""", ("fx_raw_entities", "fx_enriched"))
def build_entities(spark, sf):
    built = _built(spark, sf)
    return built.select("id", "wiki_id", "name", "class_name", "prototype", "mythology", "description", "gender",
                        "myth_source", F.col("enriched_at").isNotNull().alias("is_enriched"), "enrich_model")


@query("""WITH n AS (SELECT r.*, trim(name) AS full_name, CAST(replace(id, 'No.', '') AS BIGINT) AS wiki_id FROM fx_raw_entities r)
  SELECT concat('c', wiki_id) AS id, alias FROM (
    SELECT wiki_id, full_name AS alias FROM n UNION SELECT wiki_id, trim(split_part(full_name, '（', 1)) FROM n
    UNION SELECT wiki_id, prototype FROM n
    UNION SELECT wiki_id, extra_alias FROM n JOIN fx_enriched e ON e.id = n.id) a WHERE wiki_id > 0""",
       ("fx_raw_entities", "fx_enriched"))
def build_aliases(spark, sf):
    return entities.alias_table(_built(spark, sf)).select("id", "alias")


NAME_INDEX = """idx AS (SELECT name, first(id ORDER BY priority, wiki_id, id) AS id FROM (
    SELECT name, 0 AS priority, wiki_id, id FROM fx_entities
    UNION ALL SELECT alias, 2, wiki_id, e.id FROM fx_aliases a JOIN fx_entities e ON a.id = e.id) n GROUP BY name)"""


def _index(spark, sf):
    return entities.build_name_index(view(spark, sf, "fx_entities"), view(spark, sf, "fx_aliases"))


@query(f"WITH {NAME_INDEX} SELECT name, id FROM idx", ("fx_entities", "fx_aliases"))
def name_index(spark, sf):
    return _index(spark, sf)


RESOLVED = f"""WITH {NAME_INDEX},
  ends AS (SELECT r.*, s.id AS s_id, t.id AS t_id, trim(relationship) AS given FROM fx_raw_edges r
           LEFT JOIN idx s ON s.name = trim(source_name) LEFT JOIN idx t ON t.name = trim(target_name)),
  turned AS (SELECT *, CASE given WHEN 'CHILD_OF' THEN 'PARENT_OF' WHEN 'STUDENT_OF' THEN 'MENTOR_OF'
                                  WHEN 'SERVANT_OF' THEN 'MASTER_OF' ELSE given END AS type,
                    CASE WHEN given IN ('CHILD_OF', 'STUDENT_OF', 'SERVANT_OF') THEN t_id ELSE s_id END AS source_id,
                    CASE WHEN given IN ('CHILD_OF', 'STUDENT_OF', 'SERVANT_OF') THEN s_id ELSE t_id END AS target_id
             FROM ends WHERE s_id IS NOT NULL AND t_id IS NOT NULL AND s_id <> t_id AND given <> 'UNKNOWN_OF'),
  resolved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id),
                 greatest(source_id, target_id), type ORDER BY seq) AS nth FROM turned) x WHERE nth = 1)"""
RESOLVED_VIEWS = ("fx_raw_edges", "fx_entities", "fx_aliases")


@query(RESOLVED + " SELECT seq, source_id, target_id, type, confidence, evidence FROM resolved", RESOLVED_VIEWS)
def resolve_edges(spark, sf):
    return entities.resolve_edges(view(spark, sf, "fx_raw_edges"), _index(spark, sf)).select(
        "seq", "source_id", "target_id", "type", "confidence", "evidence")


@query(RESOLVED + """ SELECT 'records' AS metric, count(*) AS value FROM fx_raw_edges
       UNION ALL SELECT 'skipped', (SELECT count(*) FROM fx_raw_edges) - (SELECT count(*) FROM turned)
       UNION ALL SELECT 'added', count(*) FROM resolved""", RESOLVED_VIEWS)
def resolution_stats(spark, sf):
    return entities.resolution_stats(view(spark, sf, "fx_raw_edges"), _index(spark, sf))


@query(RESOLVED + """, prev AS (SELECT source_id, target_id, type, max(status) AS status FROM fx_relationships GROUP BY ALL)
  SELECT r.source_id, r.target_id, r.type,
         CASE WHEN r.status IS NOT NULL THEN r.status WHEN r.confidence IS NOT NULL THEN coalesce(p.status, 'pending')
              ELSE 'approved' END AS status,
         CASE WHEN r.origin = 'wiki' THEN 'wiki' WHEN r.confidence IS NOT NULL THEN 'llm' ELSE 'manual' END AS origin,
         coalesce(r.confidence, 'verified') AS confidence, r.type NOT IN ('ALLY_OF') AS directed
  FROM resolved r LEFT JOIN prev p ON p.source_id = r.source_id AND p.target_id = r.target_id AND p.type = r.type""",
       RESOLVED_VIEWS + ("fx_relationships",))
def assign_status(spark, sf):
    resolved = entities.resolve_edges(view(spark, sf, "fx_raw_edges"), _index(spark, sf))
    return entities.assign_status(resolved, view(spark, sf, "fx_relationships")).select(
        "source_id", "target_id", "type", "status", "origin", "confidence", "directed")


@query(RESOLVED + """ SELECT source_id, target_id, type FROM resolved r WHERE NOT EXISTS (
         SELECT 1 FROM sq_edges e WHERE e.type = r.type
           AND least(e.source_id, e.target_id) = least(r.source_id, r.target_id)
           AND greatest(e.source_id, e.target_id) = greatest(r.source_id, r.target_id))""", RESOLVED_VIEWS + ("sq_edges",))
def exclude_existing(spark, sf):
    resolved = entities.resolve_edges(view(spark, sf, "fx_raw_edges"), _index(spark, sf))
    known = edges.graph_snapshot(view(spark, sf, "fx_entities"), view(spark, sf, "fx_relationships"))
    return edges.exclude_existing(resolved, known).select("source_id", "target_id", "type")


@query("""SELECT type, count(*) AS n FROM (SELECT trim(relationship) AS type FROM fx_raw_edges) t
          WHERE type IN ('ALLY_OF', 'MENTOR_OF', 'PARENT_OF', 'CHILD_OF', 'STUDENT_OF', 'SERVANT_OF') GROUP BY type""",
       ("fx_raw_edges",))
def known_types(spark, sf):
    given = view(spark, sf, "fx_raw_edges").select(F.trim("relationship").alias("type"))
    return given.filter(edges.is_known_type(F.col("type"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(n.id, o.id) AS id, coalesce(nullif(n.region, ''), o.region) AS region,
                 coalesce(nullif(n.description, ''), o.description) AS description
          FROM fx_raw_entities o FULL JOIN fx_enriched n ON o.id = n.id""", ("fx_raw_entities", "fx_enriched"))
def merge_snapshots(spark, sf):
    old = view(spark, sf, "fx_raw_entities").select("id", "region", "description")
    new = view(spark, sf, "fx_enriched").select("id", "region", "description")
    return entities.merge_snapshots(old, new, "id")


@query("""SELECT id, name, coalesce(nullif(r.description, ''), v.description) AS description,
                 coalesce(nullif(r.gender, ''), v.gender) AS gender,
                 CASE WHEN r.region = '北欧' THEN '北欧神话' ELSE v.mythology END AS mythology, r.rid IS NOT NULL AS enriched
          FROM fx_entities v LEFT JOIN (SELECT replace(id, 'No.', 'c') AS rid, region, description, gender FROM fx_enriched) r
            ON r.rid = v.id""", ("fx_entities", "fx_enriched"))
def merge_enrichment(spark, sf):
    results = _enriched(spark, sf).select(F.regexp_replace("id", r"^No\.", "c").alias("id"), "region", "description",
                                          "metadata.gender")
    merged = entities.merge_enrichment(view(spark, sf, "fx_entities"), results)
    return merged.select("id", "name", "description", "gender", "mythology",
                         F.col("enriched_at").isNotNull().alias("enriched"))


@query("""SELECT DISTINCT id, alias FROM (SELECT id, alias FROM fx_aliases UNION ALL
          SELECT replace(id, 'No.', 'c'), extra_alias FROM fx_enriched) a""", ("fx_aliases", "fx_enriched"))
def merge_aliases(spark, sf):
    results = _enriched(spark, sf).select(F.regexp_replace("id", r"^No\.", "c").alias("id"), "aliases")
    return entities.merge_aliases(view(spark, sf, "fx_aliases"), view(spark, sf, "fx_entities"), results)


@query("SELECT id, name FROM fx_entities WHERE id NOT IN (SELECT replace(id, 'No.', 'c') FROM fx_enriched)",
       ("fx_entities", "fx_enriched"))
def enrichment_todo(spark, sf):
    results = view(spark, sf, "fx_enriched").select(F.regexp_replace("id", r"^No\.", "c").alias("id"))
    return entities.enrichment_todo(view(spark, sf, "fx_entities"), results).select("id", "name")


@query("""SELECT 'rows' AS metric, count(*) AS value FROM part
          UNION ALL SELECT 'large', count(*) FROM part WHERE p_size > 40
          UNION ALL SELECT 'dear', count(*) FROM part WHERE p_retailprice > 950""")
def stage_stats(spark, sf):
    flagged = view(spark, sf, "part").select((F.col("p_size") > 40).alias("large"), (F.col("p_retailprice") > 950).alias("dear"))
    return entities.stage_stats(flagged, ["large", "dear"])


# Mentions: line items name their part by id, name, alias or in another case.
MENTIONS = """mentions AS (SELECT l_orderkey * 1000000 + pos AS mention_id,
    CASE l_linenumber WHEN 1 THEN concat('c', p_partkey) WHEN 2 THEN concat(p_name, ' ', p_partkey) WHEN 3 THEN p_name
         WHEN 4 THEN concat(' ', p_brand) WHEN 5 THEN upper(concat(p_name, ' ', p_partkey)) ELSE concat('no ', p_name) END AS text
  FROM fx_items JOIN part ON p_partkey = l_partkey)"""


def _mentions(spark, sf):
    line = F.col("l_linenumber")
    items = view(spark, sf, "fx_items").join(view(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    full = F.concat("p_name", F.lit(" "), "p_partkey")
    text = (F.when(line == 1, F.concat(F.lit("c"), "p_partkey")).when(line == 2, full).when(line == 3, F.col("p_name"))
            .when(line == 4, F.concat(F.lit(" "), "p_brand")).when(line == 5, F.upper(full))
            .otherwise(F.concat(F.lit("no "), "p_name")))
    return items.select((F.col("l_orderkey") * 1_000_000 + F.col("pos")).alias("mention_id"), text.alias("text"))


@query("WITH " + MENTIONS + """,
  nm AS (SELECT name AS k, first(id ORDER BY wiki_id, id) AS id FROM fx_entities GROUP BY name),
  al AS (SELECT alias AS k, first(e.id ORDER BY wiki_id, e.id) AS id FROM fx_aliases a JOIN fx_entities e ON a.id = e.id GROUP BY alias),
  lo AS (SELECT lower(name) AS k, first(id ORDER BY wiki_id, id) AS id FROM fx_entities GROUP BY 1)
  SELECT mention_id, text, coalesce(CASE WHEN regexp_matches(trim(text), '^[cC][0-9]+$') THEN trim(text) END, nm.id, al.id, lo.id) AS entity_id,
         CASE WHEN regexp_matches(trim(text), '^[cC][0-9]+$') THEN 0 WHEN nm.id IS NOT NULL THEN 1 WHEN al.id IS NOT NULL THEN 2
              WHEN lo.id IS NOT NULL THEN 3 ELSE -1 END AS stage
  FROM mentions LEFT JOIN nm ON nm.k = trim(text) LEFT JOIN al ON al.k = trim(text) LEFT JOIN lo ON lo.k = lower(trim(text))""",
       ("fx_items", "fx_entities", "fx_aliases"))
def resolve_mentions(spark, sf):
    found = entities.resolve_mentions(_mentions(spark, sf), view(spark, sf, "fx_entities"), view(spark, sf, "fx_aliases"))
    return found.withColumn("stage", F.coalesce("stage", F.lit(-1)))


@query(f"""WITH cand AS (SELECT p_partkey AS seq, concat('Q', p_partkey) AS qid,
                  CASE WHEN p_size > 30 THEN concat(upper(p_name), ' ', p_partkey) WHEN p_size > 10 THEN concat('new ', p_name)
                       ELSE concat(p_name, ' ', p_partkey + 1) END AS label FROM part),
  q AS (SELECT wikidata_qid AS qid, first(id ORDER BY wiki_id, id) AS id FROM fx_qid_entities WHERE wikidata_qid IS NOT NULL GROUP BY 1),
  nm AS (SELECT {name_key('name')} AS key, first(id ORDER BY wiki_id, id) AS id FROM fx_qid_entities GROUP BY 1),
  f AS (SELECT c.*, {name_key('label')} AS key, q.id AS q_id, nm.id AS n_id FROM cand c LEFT JOIN q USING (qid)
        LEFT JOIN nm ON nm.key = {name_key('label')}),
  new AS (SELECT key, first('wd:' || qid ORDER BY seq) AS id FROM f WHERE q_id IS NULL AND n_id IS NULL GROUP BY key)
  SELECT seq, qid, label, coalesce(q_id, n_id, new.id) AS entity_id,
         CASE WHEN q_id IS NOT NULL THEN 'qid' WHEN n_id IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by
  FROM f LEFT JOIN new ON new.key = f.key""", ("fx_qid_entities",))
def match_entities(spark, sf):
    size = F.col("p_size")
    label = (F.when(size > 30, F.concat(F.upper("p_name"), F.lit(" "), "p_partkey"))
             .when(size > 10, F.concat(F.lit("new "), "p_name"))
             .otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey") + 1)))
    candidates = view(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("Q"), "p_partkey").alias("qid"),
                                                label.alias("label"))
    none = view(spark, sf, "fx_aliases").select("id", F.lit("").alias("alias"))
    return entities.match_entities(candidates, view(spark, sf, "fx_qid_entities"), none)


# --- review --------------------------------------------------------------------------------------

TURNING = """WITH tp AS (SELECT id, min(seq) FILTER (WHERE action = 'approve') AS a, min(seq) FILTER (WHERE action = 'reject') AS r
                         FROM fx_decisions GROUP BY id),
  st AS (SELECT e.*, tp.a, tp.r, tp.id IS NOT NULL AS asked,
                coalesce(status = 'pending' AND a IS NOT NULL AND (r IS NULL OR a < r), false) AS ok
         FROM fx_relationships e LEFT JOIN tp ON tp.id = e.id),
  outcome AS (SELECT d.*, CASE WHEN d.action = 'approve' AND ok AND d.seq = st.a THEN 'approved'
                               WHEN d.action = 'reject' AND st.id IS NOT NULL THEN 'rejected' ELSE 'skipped' END AS outcome
              FROM fx_decisions d LEFT JOIN st ON st.id = d.id)"""


@query(TURNING + """, noted AS (SELECT id, string_agg('｜审核备注: ' || note, '' ORDER BY seq, note) AS notes FROM outcome
                               WHERE outcome <> 'skipped' AND note <> '' GROUP BY id)
  SELECT st.id, CASE WHEN r IS NOT NULL THEN 'rejected' WHEN ok THEN 'approved' ELSE status END AS status,
         CASE WHEN ok THEN 'verified' ELSE confidence END AS confidence,
         CASE WHEN notes IS NULL THEN evidence ELSE (evidence || notes)[1:500] END AS evidence
  FROM st LEFT JOIN noted ON noted.id = st.id""", ("fx_relationships", "fx_decisions"))
def apply_decisions(spark, sf):
    changed = review.apply_decisions(view(spark, sf, "fx_relationships"), view(spark, sf, "fx_decisions"))
    return changed.select("id", "status", "confidence", "evidence")


@query(TURNING + " SELECT outcome, count(*) AS n FROM outcome GROUP BY outcome", ("fx_relationships", "fx_decisions"))
def decision_counts(spark, sf):
    return review.decision_counts(view(spark, sf, "fx_relationships"), view(spark, sf, "fx_decisions"))


@query("""SELECT id, CASE WHEN status = 'pending' AND confidence = 'high' THEN 'approved' ELSE status END AS status,
                 CASE WHEN status = 'pending' AND confidence = 'high' THEN 'verified' ELSE confidence END AS confidence
          FROM fx_relationships""", ("fx_relationships",))
def approve_confident(spark, sf):
    stored = view(spark, sf, "fx_relationships")
    return review.apply_decisions(stored, review.approve_confident(stored)).select("id", "status", "confidence")


@query("""WITH n AS (SELECT *, CASE type WHEN 'STUDENT_OF' THEN 'MENTOR_OF' ELSE type END AS t2,
                     CASE type WHEN 'STUDENT_OF' THEN target_id ELSE source_id END AS s2,
                     CASE type WHEN 'STUDENT_OF' THEN source_id ELSE target_id END AS t_id FROM fx_submissions
                     WHERE type <> 'UNKNOWN_OF'),
  k AS (SELECT *, CASE WHEN t2 = 'ALLY_OF' THEN least(s2, t_id) ELSE s2 END AS ka,
               CASE WHEN t2 = 'ALLY_OF' THEN greatest(s2, t_id) ELSE t_id END AS kb FROM n),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ka, kb, t2 ORDER BY submitted_at, contributor, evidence, s2) AS nth
                       FROM k) x WHERE nth = 1)
  SELECT s2 AS source_id, t_id AS target_id, t2 AS type, t2 <> 'ALLY_OF' AS directed,
         coalesce(nullif(evidence, ''), '用户 ' || contributor || ' 提交') AS evidence
  FROM f WHERE NOT EXISTS (SELECT 1 FROM sq_edges e WHERE e.type = t2
    AND CASE WHEN t2 = 'ALLY_OF' THEN least(e.source_id, e.target_id) ELSE e.source_id END = ka
    AND CASE WHEN t2 = 'ALLY_OF' THEN greatest(e.source_id, e.target_id) ELSE e.target_id END = kb)""",
       ("fx_submissions", "sq_edges"))
def intake(spark, sf):
    known = edges.graph_snapshot(view(spark, sf, "fx_entities"), view(spark, sf, "fx_relationships"))
    return review.intake(view(spark, sf, "fx_submissions"), known).select(
        "source_id", "target_id", "type", "directed", "evidence")


# --- harvest -------------------------------------------------------------------------------------

def _claims(spark, sf):
    return view(spark, sf, "fx_claims").select(
        "qid", F.array("class_1", "class_2").alias("p31"), F.array("based_on").alias("p144"),
        F.array("present_in").alias("p1074"), "birth_year")


def verdict_sql(said: str) -> str:
    return f"""CASE WHEN coalesce(mythic, false) AND NOT coalesce(generic, false) THEN NOT coalesce(system, false)
      WHEN regexp_matches({said}, '{vocab.STRONG_MYTHIC}') AND NOT (coalesce(generic, false)
           OR regexp_matches({said}, '{vocab.GENERIC_CLASS}')) THEN true
      ELSE coalesce(birth_year < 1900, false) AND NOT regexp_matches({said}, '{vocab.MODERN_OCCUPATION}') END"""


FACTS = f"""facts AS (SELECT c.qid, bool_or(regexp_matches(l.label || ' ', '{vocab.MYTHIC_CLASS}')) AS mythic,
    bool_or(regexp_matches(l.label || ' ', '{vocab.GENERIC_CLASS}')) AS generic,
    bool_or(regexp_matches(l.label || ' ', '{vocab.MYTH_SYSTEM}')) AS system, min(birth_year) AS birth_year
  FROM fx_claims c LEFT JOIN fx_labels l ON l.qid IN (c.class_1, c.class_2) GROUP BY c.qid),
  judged AS (SELECT m.*, {verdict_sql("coalesce(description, '')")} AS fits FROM fx_meta m LEFT JOIN facts f ON f.qid = m.qid)"""
FACT_VIEWS = ("fx_claims", "fx_labels", "fx_meta")


@query(f"WITH {FACTS} SELECT qid, label, fits AS is_prototype FROM judged", FACT_VIEWS)
def classify_historic_or_mythic(spark, sf):
    return harvest.classify_historic_or_mythic(
        view(spark, sf, "fx_meta"), _claims(spark, sf), view(spark, sf, "fx_labels")
    ).select("qid", "label", "is_prototype")


def _chars(spark, sf):
    return view(spark, sf, "part").select(
        F.col("p_partkey").alias("char_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("char_name"),
        F.lit(None).cast("string").alias("char_native"), F.array("p_brand").alias("char_alt"))


def _match(spark, sf, rated=None):
    return harvest.prototype_match(_chars(spark, sf), view(spark, sf, "fx_hits"), _claims(spark, sf),
                                   view(spark, sf, "fx_meta"), view(spark, sf, "fx_labels"), rated)


MATCHED = f"""WITH {FACTS},
  rated AS (SELECT h.*, lower(replace(label, ' ', '')) IN (lower(replace(p_name, ' ', '')) || p_partkey, lower(p_brand)) AS exact
            FROM fx_hits h JOIN part ON p_partkey = char_id),
  based AS (SELECT qid, based_on AS t_qid, 0 AS place FROM fx_claims UNION ALL SELECT qid, present_in, 1 FROM fx_claims),
  ta AS (SELECT r.char_id, r.position, r.qid, place, t_qid, j.label AS t_label FROM rated r JOIN based b ON b.qid = r.qid
         JOIN judged j ON j.qid = t_qid AND j.fits WHERE exact),
  a AS (SELECT char_id, qid AS char_qid, string_agg(t_qid, '|' ORDER BY place) AS prototype_qids,
               string_agg(t_label, ' ⇐ ' ORDER BY place) AS matched_name
        FROM ta WHERE (position, qid) = (SELECT (position, qid) FROM ta x WHERE x.char_id = ta.char_id ORDER BY position, qid LIMIT 1)
        GROUP BY char_id, qid),
  b AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY char_id ORDER BY exact DESC, position, r.qid) AS nth
                       FROM rated r JOIN judged j ON j.qid = r.qid AND j.fits) x WHERE nth = 1),
  m AS (SELECT p_partkey AS char_id, CASE WHEN a.char_id IS NOT NULL THEN 'wikidata_structured' WHEN b.exact THEN 'name_match_exact'
                    WHEN b.char_id IS NOT NULL THEN 'name_match_loose' ELSE 'unmatched' END AS method,
               a.char_qid, coalesce(a.prototype_qids, b.qid, '') AS prototype_qids,
               CASE WHEN a.char_id IS NOT NULL THEN 1.0 WHEN b.exact THEN 0.7 WHEN b.char_id IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
               coalesce(a.matched_name, b.label || '（' || b.description[1:30] || '）', '') AS matched_name
        FROM part LEFT JOIN a ON a.char_id = p_partkey LEFT JOIN b ON b.char_id = p_partkey)"""
MATCH_VIEWS = FACT_VIEWS + ("fx_hits",)


@query(MATCHED + " SELECT * FROM m", MATCH_VIEWS)
def prototype_match(spark, sf):
    return _match(spark, sf).withColumn("prototype_qids", F.array_join("prototype_qids", "|"))


@query(MATCHED + """, r AS (SELECT method, count(*) AS n FROM m GROUP BY method
    UNION ALL SELECT 'matched_total', count(*) FROM m WHERE method <> 'unmatched'
    UNION ALL SELECT 'any_candidate', count(*) FROM m WHERE char_id IN (SELECT char_id FROM fx_hits))
  SELECT method, n, round(n / (SELECT count(*) FROM m) * 100, 1) AS pct FROM r""", MATCH_VIEWS)
def match_report(spark, sf):
    rated = harvest.rate_hits(_chars(spark, sf), view(spark, sf, "fx_hits"))
    return harvest.match_report(_match(spark, sf, rated), rated)


@query(MATCHED + """ SELECT char_id, method, matched_name FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY char_id) AS nth
                     FROM m) x WHERE nth <= 15""", MATCH_VIEWS)
def match_samples(spark, sf):
    return harvest.match_samples(_match(spark, sf)).select("char_id", "method", "matched_name")


@query(MATCHED + """, p AS (SELECT char_id, exact, position, 1 AS path, 0 AS place, r.qid AS prototype_qid, CAST(NULL AS VARCHAR) AS char_qid
         FROM rated r JOIN judged j ON j.qid = r.qid AND j.fits WHERE exact
       UNION ALL SELECT char_id, exact, position, 2, place, t_qid, r.qid FROM rated r JOIN based b ON b.qid = r.qid
         JOIN judged j ON j.qid = t_qid AND j.fits)
  SELECT char_id, prototype_qid, char_qid FROM (SELECT *, row_number() OVER (PARTITION BY char_id
    ORDER BY exact DESC, position, path, place, prototype_qid) AS nth FROM p) x WHERE nth = 1""", MATCH_VIEWS)
def resolve_prototypes(spark, sf):
    seeds = _chars(spark, sf).select("char_id", "char_name", F.element_at("char_alt", 1).alias("alias"))
    found = harvest.resolve_prototypes(seeds, view(spark, sf, "fx_hits"), _claims(spark, sf),
                                       view(spark, sf, "fx_meta"), view(spark, sf, "fx_labels"))
    return found.select("char_id", "prototype_qid", "char_qid")


def _resolved_seeds(spark, sf):
    return view(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("c"), "p_partkey").alias("char_id"),
        F.col("p_name").alias("prototype_qid"), F.concat("p_name", F.lit(" of "), "p_brand").alias("prototype_label"),
        F.nullif("p_type", F.lit("STANDARD")).alias("mythology"))


@query("""SELECT 'wp:' || p_name AS id, first(p_name || ' of ' || p_brand ORDER BY p_partkey) AS name,
                 first(nullif(p_type, 'STANDARD') ORDER BY p_partkey) AS mythology FROM part GROUP BY p_name""")
def link_prototypes(spark, sf):
    return harvest.link_prototypes(_resolved_seeds(spark, sf))[0].select("id", "name", "mythology")


#: What all harvested DERIVED_FROM edges have in common.
DERIVED = "'DERIVED_FROM' AS type, true AS directed, 'verified' AS confidence, 'approved' AS status"


@query(f"""SELECT DISTINCT 'c' || p_partkey AS source_id, 'wp:' || p_name AS target_id, {DERIVED}, 'seed' AS origin,
  'FGO 角色 Wikidata 实体 P144/P1074 → ' || first_value(p_name || ' of ' || p_brand) OVER (PARTITION BY p_name ORDER BY p_partkey)
    || ' (' || p_name || ')' AS evidence FROM part""")
def prototype_edges(spark, sf):
    return harvest.link_prototypes(_resolved_seeds(spark, sf))[1]


def _incarnations(spark, sf, stored="fx_qid_entities"):
    rows = view(spark, sf, "fx_meta").join(view(spark, sf, "part"), F.col("qid") == F.concat(F.lit("Q"), "p_partkey"))
    rows = rows.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("proto"), "qid", "label", "description")
    texts = harvest.class_texts(_claims(spark, sf), view(spark, sf, "fx_labels"))
    return harvest.harvest_incarnations(rows, texts, view(spark, sf, stored), view(spark, sf, "fx_aliases"))


INCARNATED = f"""WITH tx AS (SELECT qid, string_agg(label || ' ', ' ' ORDER BY place) AS text FROM (
    SELECT c.qid, 0 AS place, l.label FROM fx_claims c JOIN fx_labels l ON l.qid = c.class_1
    UNION ALL SELECT c.qid, 1, l.label FROM fx_claims c JOIN fx_labels l ON l.qid = c.class_2) t GROUP BY qid),
  j AS (SELECT p_partkey AS seq, p_name AS proto, m.qid, m.label, lower(text) AS text,
               CASE WHEN contains(text, 'character') THEN 'character'
                    WHEN regexp_matches(text, 'video game|film|opera') THEN 'work' END AS record_kind
        FROM part JOIN fx_meta m ON m.qid = concat('Q', p_partkey) LEFT JOIN tx ON tx.qid = m.qid),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proto ORDER BY seq, qid) AS nth FROM j
                       WHERE record_kind IS NOT NULL) x WHERE nth <= 40),
  q AS (SELECT wikidata_qid AS qid, id FROM fx_qid_entities WHERE wikidata_qid IS NOT NULL),
  nm AS (SELECT {name_key('name')} AS key, first(id ORDER BY wiki_id, id) AS id FROM fx_qid_entities GROUP BY 1),
  inc AS (SELECT k.seq, k.proto, k.qid, record_kind,
    CASE WHEN record_kind = 'work' THEN 'ww:' || k.qid ELSE coalesce(q.id, nm.id, 'wd:' || k.qid) END AS entity_id,
    CASE WHEN record_kind = 'work' OR (q.id IS NULL AND nm.id IS NULL) THEN 'new' WHEN q.id IS NOT NULL THEN 'qid' ELSE 'name' END AS matched_by,
    CASE WHEN record_kind = 'character' THEN CASE WHEN contains(text, 'video game') THEN 'acg' ELSE 'other-media' END END AS medium,
    CASE WHEN record_kind = 'work' THEN CASE WHEN contains(text, 'video game') THEN 'game' WHEN contains(text, 'film') THEN 'film'
         ELSE 'stage' END END AS work_kind
  FROM k LEFT JOIN q ON q.qid = k.qid LEFT JOIN nm ON nm.key = {name_key('k.label')})"""


@query(INCARNATED + " SELECT * FROM inc", FACT_VIEWS + ("fx_qid_entities",))
def harvest_incarnations(spark, sf):
    return _incarnations(spark, sf).select("seq", "proto", "qid", "record_kind", "entity_id", "matched_by", "medium", "work_kind")


@query(INCARNATED + f""" SELECT DISTINCT entity_id AS source_id, 'wp:' || proto AS target_id, {DERIVED}, 'wikidata' AS origin,
           'wikidata P144/P1074 → ' || proto AS evidence FROM inc
         WHERE record_kind = 'character' AND (entity_id, 'wp:' || proto) NOT IN (
           SELECT (source_id, target_id) FROM fx_derived JOIN part ON 'c' || p_partkey = source_id WHERE p_size < 5)""",
       FACT_VIEWS + ("fx_qid_entities", "fx_derived"))
def incarnation_edges(spark, sf):
    small = view(spark, sf, "part").filter(F.col("p_size") < 5).select(F.concat(F.lit("c"), "p_partkey").alias("source_id"))
    known = view(spark, sf, "fx_derived").join(small, "source_id", "left_semi")
    return harvest.incarnation_edges(_incarnations(spark, sf), known)


NEW_ROWS = """, pr AS (SELECT p_name AS proto, first(nullif(p_type, 'STANDARD') ORDER BY p_partkey) AS mythology FROM part GROUP BY p_name),
  fst AS (SELECT i.*, m.label, m.description, mythology FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq, qid, proto) AS nth
            FROM inc WHERE matched_by = 'new') i JOIN fx_meta m ON m.qid = i.qid JOIN pr ON pr.proto = i.proto WHERE nth = 1),
  ch AS (SELECT entity_id AS id, CAST(0 AS INT) AS wiki_id, label AS name, mythology, description, 'wikidata' AS source,
                qid AS wikidata_qid, medium FROM fst WHERE record_kind = 'character'),
  lq AS (SELECT id, wikidata_qid FROM (SELECT entity_id AS id, qid AS wikidata_qid, row_number() OVER (PARTITION BY entity_id
           ORDER BY seq, qid) AS nth FROM inc WHERE record_kind = 'character' AND matched_by <> 'new') x
         WHERE nth = 1 AND id IN (SELECT id FROM fx_stored_entities WHERE wikidata_qid IS NULL))"""

LANDED = INCARNATED.replace("fx_qid_entities", "fx_stored_entities") + NEW_ROWS
LANDED_VIEWS = FACT_VIEWS + ("fx_stored_entities",)


def _incarnation_rows(spark, sf):
    prototypes = harvest.link_prototypes(_resolved_seeds(spark, sf))[0].select(F.col("wikidata_qid").alias("qid"), "mythology")
    return harvest.incarnation_rows(_incarnations(spark, sf, "fx_stored_entities"), prototypes)


@query(LANDED + " SELECT * FROM ch", LANDED_VIEWS)
def incarnation_characters(spark, sf):
    return _incarnation_rows(spark, sf)[0]


@query(LANDED + """ SELECT entity_id AS id, label AS name, work_kind AS kind, qid AS wikidata_qid, proto AS prototype_qid,
         'wikidata' AS source, description FROM fst WHERE record_kind = 'work'""", LANDED_VIEWS)
def incarnation_works(spark, sf):
    return _incarnation_rows(spark, sf)[1]


@query(LANDED + " SELECT * FROM lq", LANDED_VIEWS)
def learned_qids(spark, sf):
    return harvest.learned_qids(_incarnations(spark, sf, "fx_stored_entities"), view(spark, sf, "fx_stored_entities"))


@query(LANDED + """ SELECT e.id, e.name, e.mythology, e.source, coalesce(e.wikidata_qid, lq.wikidata_qid) AS wikidata_qid
         FROM fx_stored_entities e LEFT JOIN lq ON lq.id = e.id
       UNION ALL SELECT 'wp:' || p_name, first(p_name || ' of ' || p_brand ORDER BY p_partkey),
         first(nullif(p_type, 'STANDARD') ORDER BY p_partkey), 'wikidata', p_name FROM part GROUP BY p_name
       UNION ALL SELECT id, name, mythology, source, wikidata_qid FROM ch
         WHERE id NOT IN (SELECT id FROM fx_stored_entities)""", LANDED_VIEWS)
def landed_characters(spark, sf):
    """The table of characters after a harvest has been landed twice, which is as good as once."""
    found, prototypes = _incarnations(spark, sf, "fx_stored_entities"), harvest.link_prototypes(_resolved_seeds(spark, sf))[0]
    tables = {"characters": view(spark, sf, "fx_stored_entities"),
              "works": spark.createDataFrame([], "id string, name string, kind string"),
              "relationships": spark.createDataFrame([], "source_id string, target_id string, type string")}
    for _ in range(2):
        tables = land_incarnations(found, prototypes, tables)
    return tables["characters"].select("id", "name", "mythology", "source", "wikidata_qid")


def _prototypes(spark, sf):
    return view(spark, sf, "fx_all_entities").filter(F.col("class_name") == vocab.PROTOTYPE_CLASS).select(
        "id", F.col("wikidata_qid").alias("qid"), "name", "mythology")


def _linked(spark, sf):
    return harvest.link_by_exact_name(_prototypes(spark, sf), view(spark, sf, "fx_proto_aliases"), view(spark, sf, "fx_candidates"),
                                      view(spark, sf, "fx_entities"), view(spark, sf, "fx_aliases"))


LINKED = f"""WITH t AS (SELECT * FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY name) AS term_no FROM (
      SELECT id, name FROM fx_all_entities WHERE class_name = '原型'
      UNION SELECT e.id, alias FROM fx_all_entities e JOIN fx_proto_aliases a ON a.qid = e.wikidata_qid
      WHERE class_name = '原型' AND length(alias) BETWEEN 2 AND 30) n) x WHERE term_no <= 8),
  tk AS (SELECT id, {name_key('name')} AS key, min(term_no) AS term_no FROM t GROUP BY ALL),
  h AS (SELECT * FROM (SELECT tk.id AS prototype_id, term_no, cand_id, c.name AS label, key,
          row_number() OVER (PARTITION BY tk.id ORDER BY term_no, cand_id) AS nth
        FROM tk JOIN fx_candidates c ON {name_key('c.name')} = key) x WHERE nth <= 6),
  nm AS (SELECT {name_key('name')} AS key, first(id ORDER BY p, wiki_id, id) AS id FROM (
           SELECT name, 0 AS p, wiki_id, id FROM fx_entities UNION ALL
           SELECT alias, 2, wiki_id, e.id FROM fx_aliases a JOIN fx_entities e ON a.id = e.id) z GROUP BY 1),
  nw AS (SELECT h.key, first('bg:' || cand_id ORDER BY prototype_id, term_no, cand_id) AS id FROM h
         WHERE h.key NOT IN (SELECT key FROM nm) GROUP BY h.key),
  linked AS (SELECT prototype_id, cand_id, label, term_no, coalesce(nm.id, nw.id) AS entity_id,
                    CASE WHEN nm.id IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by
             FROM h LEFT JOIN nm ON nm.key = h.key LEFT JOIN nw ON nw.key = h.key)"""
LINK_VIEWS = ("fx_all_entities", "fx_proto_aliases", "fx_candidates", "fx_entities", "fx_aliases")


@query(LINKED + " SELECT id, CAST(term_no AS INT) AS term_no, name FROM t", LINK_VIEWS)
def search_names(spark, sf):
    return harvest.search_names(_prototypes(spark, sf), view(spark, sf, "fx_proto_aliases"))


@query(LINKED + " SELECT * EXCLUDE (term_no) FROM linked", LINK_VIEWS)
def link_by_exact_name(spark, sf):
    return _linked(spark, sf).drop("term_no")


@query(LINKED + f""" SELECT entity_id AS source_id, prototype_id AS target_id, {DERIVED}, 'bangumi' AS origin,
         'bangumi 精确同名 ' || first(label ORDER BY term_no, cand_id) || ' (bg:' || first(cand_id ORDER BY term_no, cand_id) || ')'
           AS evidence FROM linked GROUP BY entity_id, prototype_id""", LINK_VIEWS)
def exact_name_edges(spark, sf):
    none = spark.createDataFrame([], "source_id string, target_id string, type string")
    return harvest.exact_name_edges(_linked(spark, sf), none)


@query(LINKED + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY prototype_id, term_no, cand_id) AS nth
           FROM linked) x WHERE nth = 1)
       SELECT entity_id AS id, CASE WHEN matched_by = 'new' THEN label END AS name, cand_id AS bangumi_id,
              CASE WHEN matched_by = 'new' THEN e.mythology END AS mythology, CASE WHEN matched_by = 'new' THEN 'bangumi' END AS source
       FROM f JOIN fx_all_entities e ON e.id = prototype_id""", LINK_VIEWS)
def exact_name_rows(spark, sf):
    made, known = harvest.exact_name_rows(_linked(spark, sf), _prototypes(spark, sf), view(spark, sf, "fx_candidates"))
    return made.unionByName(known, allowMissingColumns=True).select("id", "name", "bangumi_id", "mythology", "source")


@query(LINKED + """ SELECT DISTINCT entity_id AS character_id, 'bgw:' || subject_id AS work_id FROM linked JOIN (
         SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY position, subject_id) AS nth FROM fx_subjects) s
         ON s.cand_id = linked.cand_id WHERE nth <= 5 AND trim(subject_name) <> ''""", LINK_VIEWS + ("fx_subjects",))
def link_appearances(spark, sf):
    return harvest.link_appearances(_linked(spark, sf), view(spark, sf, "fx_subjects"))[1]


FAMILY = f"""WITH {FACTS},
  an AS (SELECT wikidata_qid AS qid, id, mythology FROM fx_qid_entities WHERE wikidata_qid IS NOT NULL AND source = 'primary'),
  rw AS (SELECT * FROM (SELECT p.*, an.id AS a_id, an.mythology, row_number() OVER (PARTITION BY anchor_qid ORDER BY seq, member_qid, rel) AS nth
                        FROM fx_family_props p JOIN an ON an.qid = anchor_qid) x WHERE nth <= 15),
  members AS (SELECT 'wd:' || j.qid AS id, j.label AS name, first(rw.mythology ORDER BY seq) AS mythology, j.qid
              FROM rw JOIN judged j ON j.qid = member_qid AND j.fits
              WHERE j.qid NOT IN (SELECT wikidata_qid FROM fx_qid_entities WHERE wikidata_qid IS NOT NULL) GROUP BY j.qid, j.label),
  mi AS (SELECT rw.*, coalesce(an.id, st.id) AS m_id FROM rw LEFT JOIN an ON an.qid = member_qid LEFT JOIN (
           SELECT id, substr(id, 4) AS qid FROM fx_qid_entities WHERE starts_with(id, 'wd:') UNION SELECT id, qid FROM members) st
         ON st.qid = member_qid),
  e AS (SELECT seq, rel, CASE WHEN rel IN ('P22', 'P25') THEN m_id ELSE a_id END AS source_id,
               CASE WHEN rel IN ('P22', 'P25') THEN a_id ELSE m_id END AS target_id,
               CASE rel WHEN 'P26' THEN 'SPOUSE_OF' WHEN 'P3373' THEN 'SIBLING_OF' ELSE 'PARENT_OF' END AS type
        FROM mi WHERE m_id IS NOT NULL AND m_id <> a_id),
  fam AS (SELECT source_id, target_id, type, rel FROM (SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id),
            greatest(source_id, target_id), type ORDER BY seq) AS nth FROM e) x WHERE nth = 1)"""
FAMILY_VIEWS = FACT_VIEWS + ("fx_qid_entities", "fx_family_props")


def _family(spark, sf):
    known = edges.graph_snapshot(view(spark, sf, "fx_entities"), view(spark, sf, "fx_relationships"))
    return harvest.family_edges(view(spark, sf, "fx_qid_entities"), view(spark, sf, "fx_family_props"), view(spark, sf, "fx_meta"),
                                _claims(spark, sf), view(spark, sf, "fx_labels"), known, "primary")


@query(FAMILY + """ SELECT source_id, target_id, type, type = 'PARENT_OF' AS directed, 'verified' AS confidence,
         'wikidata:' || rel || ' 结构化家族属性' AS evidence, 'wikidata' AS origin, 'approved' AS status FROM fam f WHERE NOT EXISTS (SELECT 1 FROM sq_edges q WHERE q.type = f.type
         AND least(q.source_id, q.target_id) = least(f.source_id, f.target_id)
         AND greatest(q.source_id, q.target_id) = greatest(f.source_id, f.target_id))""", FAMILY_VIEWS + ("sq_edges",))
def family_edges(spark, sf):
    return _family(spark, sf)[1]


@query(FAMILY + " SELECT id, name, mythology FROM members", FAMILY_VIEWS)
def family_new_members(spark, sf):
    return _family(spark, sf)[0].select("id", "name", "mythology")


def _work_relations(spark, sf):
    stored = view(spark, sf, "supplier").filter(F.col("s_nationkey") < 12).select(F.concat(F.lit("alw:"), "s_suppkey").alias("id"))
    known = view(spark, sf, "supplier").select(
        F.concat(F.lit("alw:"), "s_suppkey").alias("source_id"), F.concat(F.lit("alw:"), "s_nationkey").alias("target_id"),
        F.lit("SEQUEL").alias("relation_type"))
    return harvest.work_relation_edges(view(spark, sf, "fx_work_relations"), stored, known)


WORK_EDGES = """WITH e AS (SELECT seq, CASE relation_type WHEN 'PREQUEL' THEN 'alw:' || media_id ELSE work_id END AS s,
      CASE relation_type WHEN 'PREQUEL' THEN work_id ELSE 'alw:' || media_id END AS t,
      CASE relation_type WHEN 'PREQUEL' THEN 'SEQUEL' ELSE relation_type END AS relation_type
    FROM fx_work_relations WHERE relation_type NOT IN ('CHARACTER', 'OTHER')),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(s, t), greatest(s, t), relation_type ORDER BY seq, s) AS nth FROM e) x
        WHERE nth = 1)"""


@query(WORK_EDGES + """ SELECT s AS source_id, t AS target_id, relation_type FROM f WHERE NOT (relation_type = 'SEQUEL' AND EXISTS (
         SELECT 1 FROM supplier WHERE least('alw:' || s_suppkey, 'alw:' || s_nationkey) = least(s, t)
           AND greatest('alw:' || s_suppkey, 'alw:' || s_nationkey) = greatest(s, t)))""", ("fx_work_relations",))
def work_relation_edges(spark, sf):
    return _work_relations(spark, sf)[1]


@query("""SELECT DISTINCT 'alw:' || media_id AS id, 'title ' || media_id AS name,
                 CASE media_id % 4 WHEN 0 THEN 'anime' WHEN 1 THEN 'novel' WHEN 2 THEN 'manga' ELSE 'other' END AS kind
          FROM fx_work_relations WHERE relation_type NOT IN ('CHARACTER', 'OTHER')
            AND media_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)""", ("fx_work_relations",))
def new_related_works(spark, sf):
    return _work_relations(spark, sf)[0].select("id", "name", "kind")
