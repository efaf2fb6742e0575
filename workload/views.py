"""Views that turn the test tables into graph inputs.

One SQL text serves Spark and the SQL check alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# name -> (tables and views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_entities": (("part",), """
        SELECT concat('c', p_partkey) AS id, CAST(p_partkey AS INT) AS wiki_id,
               concat(p_name, ' ', p_partkey) AS name, p_brand AS class_name, p_name AS prototype,
               CASE WHEN p_type = 'STANDARD' THEN NULL ELSE p_type END AS mythology,
               CASE WHEN p_size % 10 = 0 THEN '' ELSE concat(p_name, ' of size ', p_size) END AS description,
               CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS gender,
               CASE WHEN p_size <= 40 THEN 'primary' ELSE 'outside' END AS source
        FROM part"""),
    # Consecutive line items of one order; an order has a handful of them.
    "fx_items": (("lineitem",), """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
               row_number() OVER w AS pos, lead(l_partkey) OVER w AS nxt, lead(l_suppkey) OVER w AS nxt_supp
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)"""),
    "fx_relationships": (("fx_items", "orders"), """
        SELECT l_orderkey * 1000000 + pos AS id, concat('c', l_partkey) AS source_id, concat('c', nxt) AS target_id,
               CASE l_returnflag WHEN 'A' THEN 'ALLY_OF' WHEN 'N' THEN 'MENTOR_OF' ELSE 'PARENT_OF' END AS type,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'high'
                                    WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS confidence,
               CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F' THEN 'rejected'
                    WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'pending'
                    ELSE 'rejected' END AS status,
               CASE l_linestatus WHEN 'F' THEN 'manual' ELSE 'llm' END AS origin,
               concat('order ', l_orderkey) AS evidence, l_orderkey + pos AS turn
        FROM fx_items JOIN orders ON l_orderkey = o_orderkey
        WHERE nxt IS NOT NULL"""),
    "fx_aliases": (("part",), """
        SELECT concat('c', p_partkey) AS id, concat(p_name, ' ', p_partkey) AS alias FROM part
        UNION ALL SELECT concat('c', p_partkey), p_name FROM part
        UNION ALL SELECT concat('c', p_partkey), p_brand FROM part"""),

    # Prototype nodes, works and who appears where.
    "fx_all_entities": (("fx_entities", "part"), """
        SELECT id, wiki_id, name, class_name, mythology, description, gender, source,
               CAST(NULL AS STRING) AS wikidata_qid FROM fx_entities
        UNION ALL
        SELECT DISTINCT concat('wp:', p_name), 0, p_name, '原型', CAST(NULL AS STRING), '', '', 'outside', p_name
        FROM part"""),
    "fx_derived": (("part",), """
        SELECT CAST(p_partkey AS BIGINT) AS id, concat('c', p_partkey) AS source_id, concat('wp:', p_name) AS target_id,
               'DERIVED_FROM' AS type, 'verified' AS confidence, 'approved' AS status FROM part"""),
    "fx_works": (("supplier", "part"), """
        SELECT concat('w', s_suppkey) AS id, s_name AS name,
               CASE s_nationkey % 6 WHEN 0 THEN 'anime' WHEN 1 THEN 'manga' WHEN 2 THEN 'game' WHEN 3 THEN 'novel'
                                    WHEN 4 THEN 'film' ELSE 'other' END AS kind,
               p_name AS prototype_qid
        FROM supplier LEFT JOIN part ON s_suppkey = p_partkey"""),
    "fx_appearances": (("lineitem",), """
        SELECT DISTINCT concat('c', l_partkey) AS character_id, concat('w', l_suppkey) AS work_id FROM lineitem"""),
    "fx_selections": (("orders", "lineitem"), """
        SELECT o_custkey AS user_id, concat('c', l_partkey) AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""),

    # For the SQL checks: the reviewed graph and its neighbours.
    "sq_edges": (("fx_relationships", "fx_entities"), """
        SELECT id, source_id, target_id, type, confidence, status, origin, evidence FROM (
          SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id), type
                                       ORDER BY id) AS nth
          FROM fx_relationships
          WHERE status = 'approved' AND source_id <> target_id
            AND source_id IN (SELECT id FROM fx_entities) AND target_id IN (SELECT id FROM fx_entities)) t
        WHERE nth = 1"""),
    "sq_neighbors": (("sq_edges",), """
        SELECT source_id AS src, target_id AS dst FROM sq_edges
        UNION SELECT target_id, source_id FROM sq_edges"""),
    "sq_degree": (("sq_neighbors",), """
        SELECT src AS id, count(DISTINCT dst) AS degree FROM sq_neighbors GROUP BY src"""),
    # Raw records: entities, what enrichment knows, and relations by name.
    "fx_raw_entities": (("part",), """
        SELECT concat('No.', p_partkey) AS id,
               concat(CASE WHEN p_size = 11 THEN '阿周那 ' ELSE ' ' END, p_name, ' ', p_partkey,
                      CASE WHEN p_size > 40 THEN concat('（', p_brand, '）') ELSE '' END) AS name,
               p_brand AS class, p_name AS prototype, '' AS detail_url,
               CASE p_size % 7 WHEN 0 THEN '希腊' WHEN 1 THEN '-' WHEN 2 THEN '古代日本' WHEN 3 THEN '别处' ELSE '' END AS region,
               CASE WHEN p_size > 10 THEN concat(' about ', p_name) ELSE '' END AS description, '' AS image_url
        FROM part"""),
    "fx_enriched": (("part",), """
        SELECT concat('No.', p_partkey) AS id, CASE p_size % 4 WHEN 0 THEN '北欧' WHEN 1 THEN '?' ELSE '' END AS region,
               CASE WHEN p_size < 30 THEN concat('told of ', p_name) ELSE '' END AS description,
               CASE WHEN p_size < 20 THEN 'F' ELSE '' END AS gender, concat('alias ', p_partkey) AS extra_alias
        FROM part WHERE p_type <> 'STANDARD'"""),
    "fx_raw_edges": (("fx_relationships", "fx_entities"), """
        SELECT r.id AS seq, concat(s.name, CASE WHEN turn % 19 = 0 THEN '?' ELSE '' END) AS source_name,
               CASE WHEN turn % 13 = 0 THEN t.prototype ELSE t.name END AS target_name,
               CASE WHEN turn % 17 = 0 THEN 'UNKNOWN_OF'
                    WHEN turn % 10 = 0 THEN CASE r.type WHEN 'PARENT_OF' THEN 'CHILD_OF' WHEN 'MENTOR_OF' THEN ' STUDENT_OF'
                                                        ELSE 'SERVANT_OF ' END
                    ELSE r.type END AS relationship,
               CASE WHEN turn % 3 = 0 THEN NULL ELSE r.confidence END AS confidence,
               CASE WHEN turn % 5 = 0 THEN r.status END AS status,
               CASE WHEN turn % 7 = 0 THEN 'wiki' WHEN turn % 7 = 1 THEN 'nonsense' END AS origin, r.evidence
        FROM fx_relationships r JOIN fx_entities s ON s.id = r.source_id JOIN fx_entities t ON t.id = r.target_id"""),
    "fx_decisions": (("fx_relationships",), """
        SELECT id, turn AS seq, CASE WHEN turn % 3 = 0 THEN 'approve' ELSE 'reject' END AS action,
               concat('note ', turn) AS note FROM fx_relationships WHERE confidence <> 'low'
        UNION ALL SELECT id, turn + 1, 'reject', '' FROM fx_relationships WHERE confidence = 'high'
        UNION ALL SELECT id, turn + 2, 'approve', 'late' FROM fx_relationships WHERE confidence = 'medium'
        UNION ALL SELECT -id, turn, 'approve', '' FROM fx_relationships WHERE confidence = 'verified'"""),
    "fx_submissions": (("fx_relationships", "orders"), """
        SELECT source_id, target_id, CASE WHEN turn % 11 = 0 THEN 'STUDENT_OF' WHEN turn % 13 = 0 THEN 'UNKNOWN_OF'
                                          ELSE type END AS type,
               CASE WHEN turn % 2 = 0 THEN evidence ELSE '' END AS evidence,
               concat('user ', o_custkey) AS contributor, o_orderdate AS submitted_at
        FROM fx_relationships JOIN orders ON evidence = concat('order ', o_orderkey)"""),
    # Harvested records about the parts: claims, class labels, descriptions, search hits.
    "fx_claims": (("part",), """
        SELECT concat('Q', p_partkey) AS qid, concat('K', p_size % 12) AS class_1, concat('K', p_size % 7) AS class_2,
               concat('Q', p_partkey + 1) AS based_on, concat('Q', p_partkey + 2) AS present_in,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1800 + p_size * 4 END AS birth_year FROM part"""),
    "fx_labels": (("part",), """
        SELECT DISTINCT concat('K', p_size % 12) AS qid,
               CASE p_size % 12 WHEN 0 THEN 'deity' WHEN 1 THEN 'human' WHEN 2 THEN 'fictional character'
                                WHEN 3 THEN 'video game' WHEN 4 THEN 'Greek mythology' WHEN 5 THEN 'legendary being'
                                WHEN 6 THEN 'film' WHEN 7 THEN 'saint' WHEN 8 THEN 'given name' WHEN 9 THEN 'opera'
                                ELSE 'thing' END AS label,
               '' AS description FROM part"""),
    "fx_meta": (("part",), """
        SELECT concat('Q', p_partkey) AS qid, concat(p_name, ' ', p_partkey) AS label,
               CASE p_size % 6 WHEN 0 THEN 'legendary king of parts' WHEN 1 THEN 'singer of songs' WHEN 2 THEN 'a novel'
                               ELSE 'plain thing' END AS description FROM part"""),
    "fx_hits": (("part", "fx_items", "fx_meta"), """
        SELECT p_partkey AS char_id, 0 AS position, qid, label, description
        FROM part JOIN fx_meta ON qid = concat('Q', p_partkey) WHERE p_size > 15
        UNION ALL SELECT DISTINCT l_partkey, 1 + l_suppkey, qid, label, description
        FROM fx_items JOIN fx_meta ON qid = concat('Q', nxt) WHERE nxt <> l_partkey"""),
    "fx_qid_entities": (("part",), """
        SELECT CASE WHEN p_size = 21 THEN concat('wd:Q', p_partkey) ELSE concat('c', p_partkey) END AS id,
               CAST(p_partkey AS INT) AS wiki_id, concat(p_name, ' ', p_partkey) AS name, p_brand AS class_name,
               p_type AS mythology, CASE WHEN p_size <= 20 THEN 'primary' ELSE 'outside' END AS source,
               CASE WHEN p_size <= 21 THEN concat('Q', p_partkey) END AS wikidata_qid FROM part"""),
    "fx_stored_entities": (("fx_qid_entities",), """
        SELECT * FROM fx_qid_entities WHERE source = 'primary' OR mythology <> 'STANDARD'"""),
    "fx_family_props": (("fx_items",), """
        SELECT l_orderkey * 1000000 + pos AS seq, concat('Q', l_partkey) AS anchor_qid,
               CASE l_linenumber % 5 WHEN 0 THEN 'P22' WHEN 1 THEN 'P25' WHEN 2 THEN 'P26' WHEN 3 THEN 'P3373'
                                     ELSE 'P40' END AS rel,
               concat('Q', nxt) AS member_qid FROM fx_items WHERE nxt IS NOT NULL"""),
    "fx_work_relations": (("fx_items",), """
        SELECT l_orderkey * 1000000 + pos AS seq, concat('alw:', l_suppkey) AS work_id,
               CASE l_linenumber % 8 WHEN 0 THEN 'SEQUEL' WHEN 1 THEN 'PREQUEL' WHEN 2 THEN 'SPIN_OFF' WHEN 3 THEN 'ALTERNATIVE'
                                     WHEN 4 THEN 'SIDE_STORY' WHEN 5 THEN 'PARENT' WHEN 6 THEN 'CHARACTER' ELSE 'OTHER' END
                 AS relation_type,
               nxt_supp AS media_id, concat('title ', nxt_supp) AS title,
               CASE nxt_supp % 4 WHEN 0 THEN 'TV' WHEN 1 THEN 'NOVEL' WHEN 2 THEN 'ONE_SHOT' ELSE 'UNHEARD' END AS format
        FROM fx_items WHERE nxt IS NOT NULL AND nxt_supp <> l_suppkey"""),
    "fx_candidates": (("part",), """
        SELECT p_partkey AS cand_id,
               CASE WHEN p_size < 10 THEN p_name ELSE concat(upper(p_name), ' ', p_brand) END AS name FROM part"""),
    "fx_proto_aliases": (("part",), """
        SELECT DISTINCT p_name AS qid, concat(p_name, '-', p_brand) AS alias FROM part"""),
    "fx_subjects": (("lineitem", "supplier"), """
        SELECT DISTINCT l_partkey AS cand_id, l_linenumber AS position, l_suppkey AS subject_id,
               CASE WHEN s_nationkey % 5 = 0 THEN ' ' ELSE s_name END AS subject_name, s_nationkey % 7 AS subject_type
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""),

    # One start or pair for each prototype name.
    "fx_centers": (("part",), """
        SELECT concat('c', min(p_partkey)) AS id FROM part GROUP BY p_name"""),
    "fx_pairs": (("part",), """
        SELECT concat('c', min(p_partkey)) AS source, concat('c', max(p_partkey)) AS target FROM part GROUP BY p_name"""),
}


def closure(names: tuple[str, ...] | list[str]) -> list[str]:
    """The named views and all views they read, in an order that can be declared."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in VIEWS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(*names: str) -> str:
    """``name AS (...), ...`` for a WITH clause."""
    return ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in closure(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``VIEWS`` (or a plain table) as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    views = closure((name,))
    tables = {needed for v in views for needed in VIEWS[v][0] if needed in TABLES}
    for needed in tables:
        table(spark, sf_dir, needed).createOrReplaceTempView(needed)
    declared = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in views)
    return spark.sql(f"WITH {declared} SELECT * FROM {name}")
