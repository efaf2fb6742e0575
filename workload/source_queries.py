"""Sources, sinks, build and streaming on data derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinweave.functions import text as text_functions
from kinweave.lineage import shared_folder, spread
from kinweave.plans.build import build_all
from kinweave.sources import readers, sinks
from kinweave.streaming.intake import read_submissions, start_intake
from workload.entity_queries import _enriched
from workload.graph_queries import entities, relationships, snapshot
from workload.registry import query
from workload.views import view


def new_folder(spark, name: str) -> str:
    """A folder of its own under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/kinweave-{name}-{uuid.uuid4().hex}"


# --- landed replies and labels -------------------------------------------------------------------

@query("""SELECT qid, class_1 AS p31_first, based_on AS p144, coalesce(birth_year, -1) AS birth_year FROM (
            SELECT qid, least(class_1, class_2) AS class_1, based_on, birth_year FROM fx_claims) c""", ("fx_claims",))
def flatten_claims(spark, sf):
    def value(variable, text):
        return F.concat(F.lit(f'"{variable}":{{"value":"'), text, F.lit('"}'))

    uri = "http://example.org/entity/"
    row = F.concat(value("q", F.concat(F.lit(uri), "qid")), F.lit(","), value("p144", F.concat(F.lit(uri), "based_on")), F.lit(","))
    birth = F.when(F.col("birth_year").isNotNull(), F.concat(
        F.lit(","), value("birth", F.concat(F.lit("+"), "birth_year", F.lit("-01-01T00:00:00Z"))))).otherwise("")
    rows = [F.concat(F.lit("{"), row, value("p31", F.concat(F.lit(uri), c)), birth, F.lit("}")) for c in ("class_1", "class_2")]
    body = F.concat(F.lit('{"results":{"bindings":['), rows[0], F.lit(","), rows[1], F.lit("]}}"))
    replies = view(spark, sf, "fx_claims").select(F.col("qid").alias("reply_id"), body.alias("body"))
    return readers.flatten_claims(replies).select("qid", F.get("p31", F.lit(0)).alias("p31_first"),
                                                  F.get("p144", F.lit(0)).alias("p144"),
                                                  F.coalesce("birth_year", F.lit(-1)).alias("birth_year"))


@query("""SELECT p_partkey AS char_id, CAST(p_size AS BIGINT) AS media_id, p_type AS media_title, p_name AS char_name, p_brand AS alternative FROM part""")
def flatten_media_characters(spark, sf):
    body = F.format_string(
        '{"data":{"Page":{"media":[{"id":%d,"title":{"romaji":"%s"},"genres":[],"characters":{"nodes":[{"id":%d,'
        '"name":{"full":"%s","alternative":["%s"]}}]}}]}}}', "p_size", "p_type", "p_partkey", "p_name", "p_brand")
    replies = view(spark, sf, "part").select(body.alias("body"))
    return readers.flatten_media_characters(replies).select(
        "char_id", "media_id", "media_title", "char_name", F.get("char_alt", F.lit(0)).alias("alternative"))


@query("SELECT concat('doc ', doc_id) AS title, text FROM documents")
def flatten_wiki_pages(spark, sf):
    inner = F.to_json(F.struct(F.col("text").alias("*")))
    body = F.concat(F.lit('{"query":{"pages":{"1":{"title":"doc '), "doc_id", F.lit('","revisions":[{"slots":{"main":'), inner,
                    F.lit('}}]}}}}'))
    return readers.flatten_wiki_pages(view(spark, sf, "documents").select(body.alias("body")))


@query("""SELECT p_name AS qid, coalesce(last(p_brand ORDER BY p_partkey) FILTER (WHERE p_size % 3 = 0),
                                         first(p_brand ORDER BY p_partkey)) AS value FROM part GROUP BY p_name""")
def preferred_label(spark, sf):
    lang = F.when(F.col("p_size") % 3 == 0, "zh-hans").when(F.col("p_size") % 3 == 1, "en").otherwise("fr")
    labels = view(spark, sf, "part").select(F.col("p_name").alias("qid"), lang.alias("lang"), F.col("p_brand").alias("value"),
                                            F.col("p_partkey").alias("position"))
    return readers.preferred_label(labels)


# --- pages ---------------------------------------------------------------------------------------

def page_text_sql() -> str:
    text = "html"
    for element in text_functions.HIDDEN_ELEMENTS:
        text = rf"regexp_replace({text}, '(?is)<{element}\b[^>]*>.*?</{element}\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '(?s)<!--.*?-->', '', 'g')"
    text = rf"regexp_replace({text}, '(?s)<[^>]*>', chr(10), 'g')"
    for entity, character in text_functions.ENTITIES:
        text = f"replace({text}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(regexp_replace({text}, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {page_text_sql()} AS text FROM pages")
def page_text(spark, sf):
    return readers.page_text(spread(view(spark, sf, "pages").select("page_id", "html"), "page_id"))


@query()
def extract_detail_facts(spark, sf):
    return readers.extract_detail_facts(spread(view(spark, sf, "pages").select("page_id", "html"), "page_id"))


@query("""SELECT CAST(id AS VARCHAR) AS id, name, class, region, detail_url, image_url FROM (
            SELECT p_size AS id, p_name AS name, p_brand AS class, p_type AS region, '/w/' || p_partkey AS detail_url,
                   CASE WHEN p_size > 25 THEN 'http://x/' || p_partkey ELSE '' END AS image_url,
                   row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS nth FROM part) t WHERE nth = 1""")
def extract_index_rows(spark, sf):
    image = F.when(F.col("p_size") > 25, F.concat(F.lit('<img class="i" src="http://x/'), "p_partkey", F.lit('">'))).otherwise("")
    html = F.concat(
        F.lit("<html><body><table class='wikitable'><tr><th>No.</th><th>从者</th><th>职 阶</th><th>出典</th></tr><tr><td>No."), "p_size",
        F.lit('</td><td><a href="/w/'), "p_partkey", F.lit('"><b>'), "p_name", F.lit("</b></a>"), image, F.lit("</td><td> "), "p_brand",
        F.lit("</td><td>"), "p_type", F.lit("</td></tr><tr><td>only one</td></tr></table></body></html>"))
    pages = spread(view(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return readers.extract_index_rows(pages).select("id", "name", "class", "region", "detail_url", "image_url")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 20 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS name,
                 p_brand AS class, 'https:' || p_type AS image_url FROM part""")
def embedded_csv(spark, sf):
    over = F.when(F.col("p_size") > 20, F.concat(F.lit("id = "), "p_partkey", F.lit("\\nname_cn="), "p_name")).otherwise("")
    html = F.concat(F.lit('<script>raw_str = "id,class_link,avatar\\n'), "p_partkey", F.lit(","), "p_brand", F.lit(","), "p_type",
                    F.lit('"; override_data = "'), over, F.lit('";</script>'))
    pages = view(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return readers.embedded_csv(pages).select("id", "name", "class", "image_url")


# --- files out and in ----------------------------------------------------------------------------

@query("""SELECT replace(e.id, 'c', '') AS id, name, class_name AS class, coalesce(mythology, '') AS region, gender,
                 (SELECT string_agg(alias, '|' ORDER BY alias) FROM (SELECT DISTINCT alias FROM fx_aliases a
                  WHERE a.id = e.id AND alias <> name) x) AS aliases FROM fx_entities e""", ("fx_entities", "fx_aliases"))
def roundtrip_entities(spark, sf):
    path = new_folder(spark, "roundtrip")
    sinks.write_roundtrip(entities(spark, sf), view(spark, sf, "fx_aliases"), relationships(spark, sf), path)
    read = spark.read.schema(readers.ENRICHED_ENTITY).json(f"{path}/entities")
    return read.select("id", "name", "class", "region", "metadata.gender", F.array_join("aliases", "|").alias("aliases"))


@query("""SELECT s.name AS source_name, t.name AS target_name, type AS relationship, confidence, status, r.id
          FROM fx_relationships r JOIN fx_entities s ON s.id = source_id JOIN fx_entities t ON t.id = target_id""",
       ("fx_relationships", "fx_entities"))
def roundtrip_edges(spark, sf):
    return sinks.roundtrip_edges(relationships(spark, sf), entities(spark, sf)).select(
        "source_name", "target_name", "relationship", "confidence", "status", "id")


@query("SELECT id, name, class_name FROM fx_entities", ("fx_entities",))
def graphml_nodes(spark, sf):
    path = new_folder(spark, "graphml")
    sinks.write_graphml(entities(spark, sf), snapshot(spark, sf), path)
    schema = "_id string, data array<struct<_VALUE: string, _key: string>>"
    read = spark.read.format("xml").option("rowTag", "node").schema(schema).load(f"{path}/nodes")

    def data(key):
        return F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]

    return read.select(F.col("_id").alias("id"), data("d_name").alias("name"), data("d_class").alias("class_name"))


@query("SELECT concat('e', id) AS id, source_id, target_id, type FROM sq_edges", ("sq_edges",))
def graphml_edges(spark, sf):
    return sinks.graphml_edges(snapshot(spark, sf)).select(
        F.col("_id").alias("id"), F.col("_source").alias("source_id"), F.col("_target").alias("target_id"), F.col("data._VALUE").alias("type"))


@query("""SELECT 'node' AS element, id, '' AS source_id, '' AS target_id, name AS label FROM fx_entities
          UNION ALL SELECT 'edge', concat('e', id), source_id, target_id, type FROM sq_edges""", ("fx_entities", "sq_edges"))
def graphml_document(spark, sf):
    path = new_folder(spark, "graphml-document")
    sinks.write_graphml_document(entities(spark, sf), snapshot(spark, sf), path)
    nodes, links = readers.read_graphml_document(spark, path)
    blank = F.lit("")
    listed = nodes.select(F.lit("node").alias("element"), "id", blank.alias("source_id"), blank.alias("target_id"), F.col("name").alias("label"))
    return listed.union(links.select(F.lit("edge"), "id", "source_id", "target_id", "type"))


# --- build and stream ----------------------------------------------------------------------------

@query("""WITH made AS (SELECT * FROM fx_raw_entities WHERE id <> 'No.0')
  SELECT 'characters' AS metric, count(*) AS value FROM made
  UNION ALL SELECT 'enriched', count(*) FROM made JOIN fx_enriched USING (id)
  UNION ALL SELECT 'records', count(*) FROM fx_raw_edges""", ("fx_raw_entities", "fx_enriched", "fx_raw_edges"))
def build_all_figures(spark, sf):
    figures = build_all(spark, view(spark, sf, "fx_raw_entities"), _enriched(spark, sf), view(spark, sf, "fx_raw_edges"),
                        new_folder(spark, "build"), relationships(spark, sf))
    return figures.filter(F.col("metric").isin("characters", "enriched", "records"))


@query("""WITH n AS (SELECT CASE type WHEN 'STUDENT_OF' THEN 'MENTOR_OF' ELSE type END AS type,
                     CASE type WHEN 'STUDENT_OF' THEN target_id ELSE source_id END AS s, CASE type WHEN 'STUDENT_OF' THEN source_id ELSE target_id END AS t
                     FROM fx_submissions WHERE type <> 'UNKNOWN_OF'),
  k AS (SELECT DISTINCT CASE WHEN type = 'ALLY_OF' THEN least(s, t) ELSE s END AS first_id,
               CASE WHEN type = 'ALLY_OF' THEN greatest(s, t) ELSE t END AS second_id, type FROM n)
  SELECT first_id, second_id, type FROM k WHERE NOT EXISTS (SELECT 1 FROM sq_edges e WHERE e.type = k.type
    AND CASE WHEN k.type = 'ALLY_OF' THEN least(e.source_id, e.target_id) ELSE e.source_id END = first_id
    AND CASE WHEN k.type = 'ALLY_OF' THEN greatest(e.source_id, e.target_id) ELSE e.target_id END = second_id)""",
       ("fx_submissions", "sq_edges"))
def intake_stream(spark, sf):
    path = new_folder(spark, "intake")
    view(spark, sf, "fx_submissions").repartition(4).write.json(f"{path}/in")
    stream = read_submissions(spark, f"{path}/in", max_files=2)
    start_intake(stream, snapshot(spark, sf), f"{path}/out", f"{path}/state", once=True).awaitTermination()
    taken = spark.read.parquet(f"{path}/out")
    mutual = F.col("type") == "ALLY_OF"
    return taken.select(
        F.when(mutual, F.least("source_id", "target_id")).otherwise(F.col("source_id")).alias("first_id"),
        F.when(mutual, F.greatest("source_id", "target_id")).otherwise(F.col("target_id")).alias("second_id"), "type")
