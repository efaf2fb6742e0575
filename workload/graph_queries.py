"""Graph, listing and statistics operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.operators import community, edges, graph, links, listing, ranking, stats, traverse
from workload.registry import query
from workload.views import view


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_entities")


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_relationships")


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return edges.graph_snapshot(entities(spark, sf), relationships(spark, sf))


# --- edge tables ---------------------------------------------------------------------------------

@query("SELECT id, source_id, target_id, type, confidence, origin FROM sq_edges", ("sq_edges",))
def graph_snapshot(spark, sf):
    return snapshot(spark, sf).select("id", "source_id", "target_id", "type", "confidence", "origin")


@query("""SELECT id, source_id, target_id, type FROM (
            SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id), type
                                         ORDER BY id) AS nth FROM fx_relationships WHERE source_id <> target_id) t
          WHERE nth = 1""", ("fx_relationships",))
def canonical_edges(spark, sf):
    return edges.canonical_edges(relationships(spark, sf)).select("id", "source_id", "target_id", "type")


@query("""SELECT source_id AS src, target_id AS dst, type, id FROM sq_edges
          UNION ALL SELECT target_id, source_id, type, id FROM sq_edges""", ("sq_edges",))
def both_ways(spark, sf):
    return edges.both_ways(snapshot(spark, sf)).select("src", "dst", "type", "id")


@query("SELECT id, degree FROM sq_degree", ("sq_degree",))
def degree(spark, sf):
    return edges.degree(snapshot(spark, sf))


@query("""SELECT type, CASE WHEN type IN ('ALLY_OF') THEN false ELSE true END AS directed, count(*) AS edges
          FROM fx_relationships WHERE type IN ('ALLY_OF', 'MENTOR_OF', 'PARENT_OF') GROUP BY type""",
       ("fx_relationships",))
def relation_vocabulary(spark, sf):
    from kinweave.vocab import relation_types
    counted = relationships(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("edges"))
    return counted.join(relation_types(spark).select("type", "directed"), "type")


# --- sub-graphs ----------------------------------------------------------------------------------

SUB_FILTER = "mythology IN ('ECONOMY', 'PROMO', 'SMALL') AND gender = 'F' AND wiki_id <= 1000000000"


def _subgraph(spark, sf, **more):
    return graph.subgraph(
        entities(spark, sf), snapshot(spark, sf), mythologies=["ECONOMY", "PROMO", "SMALL"], gender="F",
        max_wiki_id=1_000_000_000, types=["ALLY_OF", "PARENT_OF"], only_related=True, group_nodes=True, **more)


SUB_SQL = f"""WITH allowed AS (SELECT * FROM fx_entities WHERE {SUB_FILTER}),
  l AS (SELECT source_id, target_id, type, confidence FROM sq_edges
        WHERE type IN ('ALLY_OF', 'PARENT_OF') AND source_id IN (SELECT id FROM allowed)
          AND target_id IN (SELECT id FROM allowed)),
  n AS (SELECT a.id, name, 'character' AS kind, mythology, class_name, coalesce(degree, 0) AS degree, wiki_id
        FROM allowed a LEFT JOIN sq_degree d ON a.id = d.id
        WHERE a.id IN (SELECT source_id FROM l UNION SELECT target_id FROM l))"""


@query(SUB_SQL + """
  SELECT * FROM n UNION ALL
  SELECT concat('m:', coalesce(nullif(mythology, ''), '其他')), coalesce(nullif(mythology, ''), '其他'), 'myth',
         coalesce(nullif(mythology, ''), '其他'), '', count(*), 0 FROM n GROUP BY coalesce(nullif(mythology, ''), '其他')""",
       ("fx_entities", "sq_edges", "sq_degree"))
def subgraph_nodes(spark, sf):
    return _subgraph(spark, sf)[0]


@query(SUB_SQL + """
  SELECT * FROM l UNION ALL
  SELECT id, concat('m:', coalesce(nullif(mythology, ''), '其他')), 'BELONGS_TO', 'verified' FROM n""",
       ("fx_entities", "sq_edges", "sq_degree"))
def subgraph_links(spark, sf):
    return _subgraph(spark, sf)[1]


@query(SUB_SQL + " SELECT * FROM l", ("fx_entities", "sq_edges", "sq_degree"))
def subgraph_links_strict(spark, sf):
    """The type filter takes the membership links of group nodes away too."""
    return _subgraph(spark, sf, strict_types=True)[1]


@query("""WITH hits AS (SELECT id FROM fx_entities WHERE contains(name, 'gear') OR contains(prototype, 'gear'))
          SELECT id FROM hits UNION SELECT dst FROM sq_neighbors WHERE src IN (SELECT id FROM hits)""",
       ("fx_entities", "sq_neighbors"))
def search_expand(spark, sf):
    return graph.search_expand(entities(spark, sf), snapshot(spark, sf), "gear")


WALK = """WITH walk AS (SELECT id AS center, id, 0 AS distance FROM fx_centers
                        UNION SELECT center, dst, distance + 1 FROM walk JOIN sq_neighbors ON id = src WHERE distance < {hops}),
  near AS (SELECT center, id, min(distance) AS distance FROM walk GROUP BY center, id)"""


@query(WALK.format(hops=2) + """
  SELECT n.center, n.id, n.distance FROM near n JOIN fx_entities e ON n.id = e.id WHERE e.gender = 'F'
  UNION ALL SELECT id, id, 0 FROM fx_centers WHERE id NOT IN (
    SELECT n.center FROM near n JOIN fx_entities e ON n.id = e.id WHERE e.gender = 'F')""",
       ("fx_entities", "fx_centers", "sq_neighbors"), recursive=True)
def ego_network(spark, sf):
    return graph.ego_network(entities(spark, sf), snapshot(spark, sf), view(spark, sf, "fx_centers"), 2, gender="F")


@query("""WITH walk AS (SELECT id AS key, id, 0 AS distance FROM fx_centers
                        UNION SELECT key, dst, 1 FROM walk JOIN sq_neighbors ON id = src WHERE distance = 0)
  SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS nth
                       FROM (SELECT DISTINCT key, id FROM walk) w) t WHERE nth <= 4""",
       ("fx_centers", "sq_neighbors"), recursive=True)
def context_subgraph(spark, sf):
    seeds = view(spark, sf, "fx_centers").select(F.col("id").alias("key"), "id")
    return graph.context_subgraph(entities(spark, sf), snapshot(spark, sf), seeds, hops=1, cap=4)


FAMILY = """WITH kin AS (SELECT * FROM sq_edges WHERE type IN ('PARENT_OF', 'SIBLING_OF', 'SPOUSE_OF', 'LOVER_OF')),
  steps AS (SELECT source_id AS src, target_id AS dst FROM kin UNION SELECT target_id, source_id FROM kin),
  walk AS (SELECT id AS root, id, 0 AS distance FROM fx_centers
           UNION SELECT root, dst, distance + 1 FROM walk JOIN steps ON id = src WHERE distance < 3),
  near AS (SELECT root, id, min(distance) AS distance FROM walk GROUP BY root, id)"""


def _family(spark, sf):
    return graph.family_tree(entities(spark, sf), snapshot(spark, sf), view(spark, sf, "fx_centers"))


@query(FAMILY + " SELECT root, id, distance FROM near", ("fx_centers", "sq_edges"), recursive=True)
def family_members(spark, sf):
    return _family(spark, sf)[0]


@query(FAMILY + """ SELECT a.root, k.source_id, k.target_id, k.type FROM kin k JOIN near a ON a.id = k.source_id
                    JOIN near b ON b.id = k.target_id AND b.root = a.root""", ("fx_centers", "sq_edges"), recursive=True)
def family_links(spark, sf):
    return _family(spark, sf)[1].select("root", "source_id", "target_id", "type")


@query("""WITH kin AS (SELECT source_id AS src, target_id AS dst, CASE type WHEN 'PARENT_OF' THEN 1 ELSE 0 END AS shift
                       FROM sq_edges WHERE type IN ('PARENT_OF', 'SIBLING_OF', 'SPOUSE_OF', 'LOVER_OF')),
  steps AS (SELECT src, dst, min(shift) AS shift FROM (SELECT * FROM kin UNION ALL SELECT dst, src, -shift FROM kin) s
            GROUP BY src, dst),
  h1 AS (SELECT root, id, 1 AS hops, min(level) AS level FROM (
           SELECT c.id AS root, s.dst AS id, s.shift AS level FROM fx_centers c JOIN steps s ON c.id = s.src) t
         WHERE root <> id GROUP BY root, id),
  h2 AS (SELECT h.root, s.dst AS id, 2 AS hops, min(h.level + s.shift) AS level FROM h1 h JOIN steps s ON h.id = s.src
         WHERE s.dst <> h.root AND (h.root, s.dst) NOT IN (SELECT (root, id) FROM h1) GROUP BY h.root, s.dst),
  h3 AS (SELECT h.root, s.dst AS id, 3 AS hops, min(h.level + s.shift) AS level FROM h2 h JOIN steps s ON h.id = s.src
         WHERE s.dst <> h.root AND (h.root, s.dst) NOT IN (SELECT (root, id) FROM h1)
           AND (h.root, s.dst) NOT IN (SELECT (root, id) FROM h2) GROUP BY h.root, s.dst)
  SELECT id AS root, id, 0 AS hops, 0 AS level FROM fx_centers
  UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""", ("fx_centers", "sq_edges"))
def generation_level(spark, sf):
    return traverse.generation_level(snapshot(spark, sf), view(spark, sf, "fx_centers"))


# --- paths ---------------------------------------------------------------------------------------

PAIR_WALK = """WITH walk AS (SELECT DISTINCT source, source AS id, 0 AS distance FROM fx_pairs
                 UNION SELECT source, dst, distance + 1 FROM walk JOIN sq_neighbors ON id = src WHERE distance < 6),
  far AS (SELECT source, id, min(distance) AS distance FROM walk GROUP BY source, id)"""


@query(PAIR_WALK + """ SELECT p.source, p.target, f.distance IS NOT NULL AS found, coalesce(f.distance, 0) AS distance
                       FROM fx_pairs p LEFT JOIN far f ON p.source = f.source AND p.target = f.id""",
       ("fx_pairs", "sq_neighbors"), recursive=True)
def shortest_paths(spark, sf):
    paths = traverse.shortest_paths(entities(spark, sf), snapshot(spark, sf), view(spark, sf, "fx_pairs"))
    return paths.select("source", "target", "found", "distance")


@query()
def shortest_path_steps(spark, sf):
    graph_edges = snapshot(spark, sf)
    paths = traverse.shortest_paths(entities(spark, sf), graph_edges, view(spark, sf, "fx_pairs"))
    return traverse.path_steps(graph_edges, paths)


@query(WALK.format(hops=4) + " SELECT center AS source, id, distance FROM near", ("fx_centers", "sq_neighbors"),
       recursive=True)
def bfs_distances(spark, sf):
    return traverse.bfs_distances(snapshot(spark, sf), view(spark, sf, "fx_centers"), 4)


@query("""WITH links AS (SELECT l_orderkey AS chain, concat('c', l_partkey) AS src, 'c' || nxt AS dst FROM fx_items),
  checked AS (SELECT chain, dst, (SELECT count(*) FROM sq_neighbors n WHERE n.src = l.src AND n.dst = l.dst) AS known
              FROM links l)
  SELECT chain, count(dst) AS links, count(*) FILTER (WHERE dst IS NOT NULL AND known = 0) AS broken,
         count(*) FILTER (WHERE dst IS NOT NULL AND known = 0) = 0 AS valid FROM checked GROUP BY chain""",
       ("fx_items", "sq_neighbors"))
def validate_chains(spark, sf):
    steps = view(spark, sf, "fx_items").select(
        F.col("l_orderkey").alias("chain"), "pos", F.concat(F.lit("c"), "l_partkey").alias("id"))
    return traverse.validate_chains(steps, snapshot(spark, sf))


@query("""WITH walk AS (SELECT DISTINCT target, target AS id, 0 AS distance FROM fx_pairs
                 UNION SELECT target, dst, distance + 1 FROM walk JOIN sq_neighbors ON id = src WHERE distance < 6),
  far AS (SELECT target, id, min(distance) AS distance FROM walk GROUP BY target, id)
  SELECT p.source AS current, p.target, min(b.id) AS next_id, min(a.distance) AS distance
  FROM fx_pairs p JOIN far a ON a.target = p.target AND a.id = p.source
  JOIN sq_neighbors n ON n.src = p.source JOIN far b ON b.target = p.target AND b.id = n.dst AND b.distance = a.distance - 1
  GROUP BY p.source, p.target""", ("fx_pairs", "sq_neighbors"), recursive=True)
def next_hop(spark, sf):
    asks = view(spark, sf, "fx_pairs").select(F.col("source").alias("current"), "target")
    return traverse.next_hop(snapshot(spark, sf), asks)


@query()
def sample_pairs_at_distance(spark, sf):
    seeds = view(spark, sf, "orders").select(
        F.date_format(F.date_trunc("year", "o_orderdate"), "yyyy-MM-dd").alias("seed")).distinct()
    return traverse.sample_pairs_at_distance(entities(spark, sf), snapshot(spark, sf), seeds)


# --- communities and suggestions -----------------------------------------------------------------

@query()
def communities(spark, sf):
    found = community.communities(entities(spark, sf), snapshot(spark, sf))
    return community.community_summary(entities(spark, sf), found)


@query()
def community_members(spark, sf):
    found = cut(community.communities(entities(spark, sf), snapshot(spark, sf)))
    return community.community_members(community.community_summary(entities(spark, sf), found), found)


@query("""SELECT count(*) AS vertices, count(*) AS members, CAST(0 AS BIGINT) AS named_otherwise, CAST(0 AS BIGINT) AS rising_moves,
                 true AS above_start FROM fx_entities""", ("fx_entities",))
def community_invariants(spark, sf):
    """Each vertex is in one community, named by its smallest member; no move of a vertex raises modularity,
    which is not below that of single vertices."""
    known, snap = entities(spark, sf), cut(snapshot(spark, sf))
    found = cut(community.communities(known, snap))
    least = found.groupBy("community").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    start = community.modularity(snap, known.select("id", F.col("id").alias("community")))
    rising = community.rising_moves(snap, found).agg(F.count("*").alias("rising_moves"))
    return (found.agg(F.count_distinct("id").alias("vertices"))
            .join(least.agg(F.sum("n").alias("members"), F.count_if(F.col("least") != F.col("community")).alias("named_otherwise")))
            .join(rising).withColumn("above_start", F.lit(community.modularity(snap, found) >= start)))


@query("""WITH named AS (SELECT class_name AS community, coalesce(nullif(mythology, ''), '其他') AS mythology, count(*) AS n
                         FROM fx_entities GROUP BY ALL)
  SELECT community, CAST(sum(n) AS BIGINT) AS size, first(mythology ORDER BY n DESC, mythology) AS top_mythology
  FROM named GROUP BY community""", ("fx_entities",))
def top_mythology(spark, sf):
    assignment = entities(spark, sf).select("id", F.col("class_name").alias("community"))
    return community.top_mythology(entities(spark, sf), assignment)


@query("""WITH p AS (SELECT x.src AS a, y.src AS b, x.dst AS via FROM sq_neighbors x JOIN sq_neighbors y
                     ON x.dst = y.dst AND x.src < y.src
                     JOIN fx_entities ea ON ea.id = x.src JOIN fx_entities eb ON eb.id = y.src
                     WHERE ea.mythology = eb.mythology AND ea.mythology <> ''),
  s AS (SELECT a, b, count(*) AS shared, list_sort(list(via))[1:6] AS ids FROM p
        WHERE NOT EXISTS (SELECT 1 FROM sq_neighbors n WHERE n.src = a AND n.dst = b) GROUP BY a, b)
  SELECT a AS source_id, b AS target_id, shared, round(shared * 2.1, 2)::DOUBLE AS score,
         array_to_string(ids, '|') AS shared_ids
  FROM s ORDER BY shared DESC, a, b LIMIT 20""", ("sq_neighbors", "fx_entities"))
def suggest_links(spark, sf):
    best = links.suggest_links(entities(spark, sf), snapshot(spark, sf), 20)
    return best.withColumn("shared_ids", F.array_join("shared_ids", "|"))


# --- listings ------------------------------------------------------------------------------------

@query("""SELECT e.id, wiki_id, name, class_name, mythology, coalesce(degree, 0) AS degree,
                 coalesce(degree, 0) > 0 AS has_relation
          FROM fx_entities e LEFT JOIN sq_degree d ON e.id = d.id
          WHERE gender = 'M' AND contains(name, 'gear') AND coalesce(degree, 0) > 0
          ORDER BY wiki_id, e.id LIMIT 50 OFFSET 10""", ("fx_entities", "sq_degree"))
def list_entities(spark, sf):
    return listing.list_entities(entities(spark, sf), snapshot(spark, sf), gender="M", search="gear",
                                 has_relation=True, limit=50, offset=10)


@query("""SELECT DISTINCT 'class_name' AS facet, class_name AS value FROM fx_entities WHERE class_name <> ''
          UNION ALL SELECT DISTINCT 'mythology', mythology FROM fx_entities WHERE mythology <> ''
          UNION ALL SELECT DISTINCT 'source', source FROM fx_entities WHERE source <> ''""", ("fx_entities",))
def facet_values(spark, sf):
    return listing.facet_values(entities(spark, sf), ["class_name", "mythology", "source"])


@query("SELECT mythology, count(*) AS entities FROM fx_entities WHERE mythology <> '' GROUP BY mythology",
       ("fx_entities",))
def mythology_counts(spark, sf):
    return listing.mythology_counts(entities(spark, sf))


@query("""SELECT type, CASE type WHEN 'PARENT_OF' THEN 'family' ELSE 'social' END AS category,
                 CASE type WHEN 'PARENT_OF' THEN '父母' WHEN 'ALLY_OF' THEN '盟友' ELSE '师傅' END AS label,
                 count(*) AS edges FROM sq_edges GROUP BY type""", ("sq_edges",))
def present_types(spark, sf):
    return listing.present_types(snapshot(spark, sf))


@query("""SELECT e.id, name, class_name, mythology, coalesce(degree, 0) AS degree, coalesce(n, 0) AS aliases
          FROM fx_entities e LEFT JOIN sq_degree d ON e.id = d.id
          LEFT JOIN (SELECT id, count(DISTINCT alias) AS n FROM fx_aliases GROUP BY id) a ON e.id = a.id""",
       ("fx_entities", "sq_degree", "fx_aliases"))
def entity_profile(spark, sf):
    full = listing.entity_profile(entities(spark, sf), view(spark, sf, "fx_aliases"), snapshot(spark, sf))
    return full.select("id", "name", "class_name", "mythology", "degree", "aliases")


@query("SELECT DISTINCT id, alias FROM fx_aliases", ("fx_aliases",))
def entity_aliases(spark, sf):
    return listing.entity_aliases(view(spark, sf, "fx_aliases"))


@query("""SELECT c.id AS entity_id, r.id, r.source_id, r.target_id, r.type, r.status, s.name AS source_name,
                 t.name AS target_name
          FROM fx_relationships r JOIN fx_centers c ON c.id = r.source_id OR c.id = r.target_id
          JOIN fx_entities s ON s.id = r.source_id JOIN fx_entities t ON t.id = r.target_id""",
       ("fx_relationships", "fx_centers", "fx_entities"))
def incident_edges(spark, sf):
    touched = listing.incident_edges(relationships(spark, sf), entities(spark, sf), view(spark, sf, "fx_centers"),
                                     include_pending=True)
    return touched.select("entity_id", "id", "source_id", "target_id", "type", "status", "source_name", "target_name")


LISTED = "r.id, r.source_id, r.target_id, r.type, r.confidence, r.origin, s.name AS source_name, t.name AS target_name"


@query(f"""SELECT {LISTED} FROM (SELECT * FROM fx_relationships WHERE status = 'approved' AND origin = 'manual'
             AND confidence = 'verified' ORDER BY id DESC LIMIT 100 OFFSET 100) r
           JOIN fx_entities s ON s.id = r.source_id JOIN fx_entities t ON t.id = r.target_id""",
       ("fx_relationships", "fx_entities"))
def list_edges(spark, sf):
    listed = listing.list_edges(relationships(spark, sf), entities(spark, sf), status="approved", origin="manual",
                                confidence="verified", limit=100, offset=100)
    return listed.select("id", "source_id", "target_id", "type", "confidence", "origin", "source_name", "target_name")


@query("SELECT count(*) AS total FROM fx_relationships WHERE status = 'approved' AND origin = 'manual'",
       ("fx_relationships",))
def count_edges(spark, sf):
    return listing.count_edges(relationships(spark, sf), status="approved", origin="manual")


@query(f"""SELECT {LISTED} FROM (SELECT * FROM fx_relationships WHERE status = 'pending' ORDER BY id DESC LIMIT 50) r
           JOIN fx_entities s ON s.id = r.source_id JOIN fx_entities t ON t.id = r.target_id""",
       ("fx_relationships", "fx_entities"))
def pending_queue(spark, sf):
    queue = listing.pending_queue(relationships(spark, sf), entities(spark, sf))
    return queue.select("id", "source_id", "target_id", "type", "confidence", "origin", "source_name", "target_name")


@query("""SELECT source_id, s.name AS source_name, target_id, t.name AS target_name, type AS relationship,
                 CASE type WHEN 'PARENT_OF' THEN '父母' WHEN 'ALLY_OF' THEN '盟友' ELSE '师傅' END AS label
          FROM sq_edges r JOIN fx_entities s ON s.id = r.source_id JOIN fx_entities t ON t.id = r.target_id""",
       ("sq_edges", "fx_entities"))
def edges_export(spark, sf):
    return listing.edges_export(snapshot(spark, sf), entities(spark, sf))


@query("""SELECT e.id, name, class_name AS class, coalesce(mythology, '') AS mythology, gender,
                 coalesce(degree, 0) AS degree, wiki_id
          FROM fx_entities e LEFT JOIN sq_degree d ON e.id = d.id ORDER BY wiki_id, e.id LIMIT 1000""",
       ("fx_entities", "sq_degree"))
def nodes_export(spark, sf):
    return listing.nodes_export(entities(spark, sf), snapshot(spark, sf), 1000)


# --- statistics ----------------------------------------------------------------------------------

@query("""SELECT 'characters' AS metric, count(*) AS value FROM fx_entities
  UNION ALL SELECT 'enriched', 0
  UNION ALL SELECT 'missing_mythology', count(*) FROM fx_entities WHERE coalesce(mythology, '') = ''
  UNION ALL SELECT 'missing_description', count(*) FROM fx_entities WHERE description = ''
  UNION ALL SELECT 'relationships', count(*) FROM fx_relationships
  UNION ALL SELECT 'approved', count(*) FROM fx_relationships WHERE status = 'approved'
  UNION ALL SELECT 'pending', count(*) FROM fx_relationships WHERE status = 'pending'
  UNION ALL SELECT 'orphan_nodes', count(*) FROM fx_entities WHERE id NOT IN (SELECT src FROM sq_neighbors)""",
       ("fx_entities", "fx_relationships", "sq_neighbors"))
def quality_stats(spark, sf):
    return stats.quality_stats(entities(spark, sf), relationships(spark, sf), snapshot(spark, sf))


@query("""SELECT 'type' AS dimension, type AS value, count(*) AS n FROM fx_relationships GROUP BY type
  UNION ALL SELECT 'confidence', confidence, count(*) FROM fx_relationships GROUP BY confidence
  UNION ALL SELECT 'origin', origin, count(*) FROM fx_relationships GROUP BY origin
  UNION ALL SELECT 'mythology', coalesce(nullif(mythology, ''), '未归类'), count(*) FROM fx_entities GROUP BY 2
  UNION ALL SELECT 'class', class_name, count(*) FROM fx_entities WHERE class_name <> '' GROUP BY 2""",
       ("fx_entities", "fx_relationships"))
def distributions(spark, sf):
    return stats.distributions(entities(spark, sf), relationships(spark, sf))


def _radar_inputs(spark, sf):
    return [view(spark, sf, name) for name in ("fx_all_entities", "fx_derived", "fx_works", "fx_appearances")]


RADAR = """WITH inc AS (SELECT target_id AS prototype_id, count(*) FILTER (WHERE source = 'primary') AS own,
                               count(*) FILTER (WHERE source <> 'primary') AS others
                        FROM fx_derived d JOIN fx_all_entities e ON e.id = d.source_id GROUP BY target_id),
  wk AS (SELECT prototype_qid, count(*) AS works FROM fx_works WHERE prototype_qid IS NOT NULL GROUP BY 1),
  radar AS (SELECT e.id, e.name, coalesce(mythology, '') AS mythology, coalesce(own, 0) AS own,
                   coalesce(others, 0) AS others, coalesce(works, 0) AS works,
                   coalesce(own, 0) + coalesce(others, 0) AS incarnations
            FROM fx_all_entities e LEFT JOIN inc ON prototype_id = e.id LEFT JOIN wk ON prototype_qid = wikidata_qid
            WHERE class_name = '原型')"""
WORKS_OF = """, w AS (SELECT character_id, array_to_string(list(name ORDER BY work_id), '|') AS works FROM (
       SELECT character_id, work_id, name, row_number() OVER (PARTITION BY character_id ORDER BY work_id) AS nth
       FROM fx_appearances JOIN fx_works ON id = work_id) t WHERE nth <= {k} GROUP BY character_id)"""
RADAR_VIEWS = ("fx_all_entities", "fx_derived", "fx_works", "fx_appearances")


@query(RADAR + " SELECT * FROM radar", RADAR_VIEWS)
def prototype_radar(spark, sf):
    vertices, derived, works, _ = _radar_inputs(spark, sf)
    return stats.prototype_radar(vertices, derived, works, "primary")


@query(RADAR + WORKS_OF.format(k=3) + """ SELECT d.target_id AS prototype_id, e.id, e.name, source = 'primary' AS own,
           class_name, description[1:80] AS description, coalesce(w.works, '') AS works
         FROM fx_derived d JOIN fx_all_entities e ON e.id = d.source_id LEFT JOIN w ON character_id = e.id""", RADAR_VIEWS)
def prototype_incarnations(spark, sf):
    vertices, derived, works, appearances = _radar_inputs(spark, sf)
    rows = stats.prototype_incarnations(vertices, derived, appearances, works, "primary")
    return rows.withColumn("works", F.array_join("works", "|"))


@query(RADAR + """ SELECT id, incarnations, works FROM radar WHERE contains(lower(name), 'gear') OR id IN (
           SELECT d.target_id FROM fx_derived d JOIN fx_all_entities e ON e.id = d.source_id
           WHERE source = 'primary' AND contains(lower(e.name), 'gear'))
         OR substr(id, 4) IN (SELECT prototype_qid FROM fx_works WHERE contains(lower(name), 'gear'))""", RADAR_VIEWS)
def filter_prototypes(spark, sf):
    vertices, derived, works, appearances = _radar_inputs(spark, sf)
    radar = stats.prototype_radar(vertices, derived, works, "primary")
    rows = stats.prototype_incarnations(vertices, derived, appearances, works, "primary")
    return stats.filter_prototypes(radar, rows, works, " Gear").select("id", "incarnations", "works")


@query(RADAR + WORKS_OF.format(k=5) + """ SELECT d.target_id AS prototype_id,
           CASE source WHEN 'primary' THEN 0 ELSE 1 END AS sort_no, e.id, e.name, source, class_name, gender,
           coalesce(mythology, '') AS mythology, coalesce(w.works, '') AS works
         FROM fx_derived d JOIN fx_all_entities e ON e.id = d.source_id LEFT JOIN w ON character_id = e.id""", RADAR_VIEWS)
def evolution_matrix(spark, sf):
    vertices, derived, works, appearances = _radar_inputs(spark, sf)
    rows = stats.evolution_matrix(vertices, derived, appearances, works, "primary")
    return rows.withColumn("works", F.array_join("works", "|"))


PROFILE = """WITH sel AS (SELECT DISTINCT user_id, s.id, class_name, coalesce(nullif(mythology, ''), '未归类') AS mythology
                     FROM fx_selections s JOIN fx_all_entities e ON e.id = s.id),
  tot AS (SELECT user_id, count(*) AS total, count(DISTINCT mythology) AS mythologies FROM sel GROUP BY user_id),
  cls AS (SELECT user_id, class_name, count(*) AS n FROM sel WHERE class_name <> '' GROUP BY ALL),
  top AS (SELECT user_id, array_to_string((list(class_name ORDER BY n DESC, class_name))[1:3], '|') AS top_classes
          FROM cls GROUP BY user_id),
  pro AS (SELECT user_id, target_id, count(*) AS members FROM sel JOIN fx_derived d ON d.source_id = sel.id GROUP BY ALL),
  g AS (SELECT user_id, count(*) FILTER (WHERE members >= 2) AS shared_prototypes,
               first(target_id ORDER BY members DESC, target_id) AS guardian, max(members) AS guardian_members
        FROM pro GROUP BY user_id)"""


@query(PROFILE + """ SELECT t.user_id, total, mythologies, round(mythologies / total, 2) AS diversity, top_classes,
                     coalesce(shared_prototypes, 0) AS shared_prototypes, guardian, guardian_members
         FROM tot t LEFT JOIN top USING (user_id) LEFT JOIN g USING (user_id)""",
       ("fx_selections", "fx_all_entities", "fx_derived"))
def selection_profile(spark, sf):
    profile = stats.selection_profile(view(spark, sf, "fx_selections"), view(spark, sf, "fx_all_entities"),
                                      view(spark, sf, "fx_derived"))
    return profile.withColumn("top_classes", F.array_join("top_classes", "|"))


@query(PROFILE + " SELECT user_id, target_id AS prototype_id, members FROM pro",
       ("fx_selections", "fx_all_entities", "fx_derived"))
def selection_prototypes(spark, sf):
    return stats.selection_prototypes(view(spark, sf, "fx_selections"), view(spark, sf, "fx_all_entities"),
                                      view(spark, sf, "fx_derived"))


@query(PROFILE + " SELECT user_id, mythology, count(*) AS n FROM sel GROUP BY user_id, mythology",
       ("fx_selections", "fx_all_entities", "fx_derived"))
def selection_distribution(spark, sf):
    return stats.selection_distribution(view(spark, sf, "fx_selections"), view(spark, sf, "fx_all_entities"))


# --- ranking -------------------------------------------------------------------------------------

@query("""SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM (
            SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS nth
            FROM lineitem WHERE l_quantity > 10) t WHERE nth <= 15""")
def cap_per_group(spark, sf):
    items = view(spark, sf, "lineitem").filter(F.col("l_quantity") > 10).select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")
    return ranking.cap_per_group(items, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_partkey"], 15)


@query("""SELECT prototype, id, name FROM (SELECT *, row_number() OVER (PARTITION BY prototype ORDER BY wiki_id, id) AS nth
          FROM fx_entities) t WHERE nth = 1""", ("fx_entities",))
def first_per_key(spark, sf):
    return ranking.first_per_key(entities(spark, sf), ["prototype"], ["wiki_id", "id"]).select("prototype", "id", "name")


@query("SELECT id, wiki_id, name FROM fx_entities ORDER BY name, id LIMIT 40", ("fx_entities",))
def top_n(spark, sf):
    return ranking.top_n(entities(spark, sf), ["name", "id"], 40).select("id", "wiki_id", "name")


@query("SELECT id, wiki_id, name FROM fx_entities ORDER BY wiki_id, id LIMIT 100 OFFSET 50", ("fx_entities",))
def page(spark, sf):
    return ranking.page(entities(spark, sf), ["wiki_id", "id"], 100, 50).select("id", "wiki_id", "name")


@query("""WITH pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM fx_entities
                        WHERE description <> '' AND mythology <> ''),
  seeds AS (SELECT DISTINCT concat('daily-', strftime(o_orderdate, '%Y-%m-%d')) AS seed FROM orders)
  SELECT seed, id FROM seeds JOIN pool
    ON position = CAST(concat('0x', sha256(seed)[1:8]) AS BIGINT) % (SELECT count(*) FROM pool)""", ("fx_entities",))
def deterministic_pick(spark, sf):
    pool = entities(spark, sf).filter((F.col("description") != "") & (F.coalesce("mythology", F.lit("")) != ""))
    seeds = view(spark, sf, "orders").select(
        F.concat(F.lit("daily-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("seed")).distinct()
    return ranking.pick_by_hash(pool, seeds)


@query("""WITH m AS (SELECT mythology, id, name, (row_number() OVER (PARTITION BY mythology ORDER BY id) - 1) // 12 AS batch_no,
                            count(*) OVER (PARTITION BY mythology) AS group_size
                     FROM fx_entities WHERE mythology IS NOT NULL),
  b AS (SELECT mythology, group_size, batch_no, list(name ORDER BY id) AS members FROM m GROUP BY ALL),
  n AS (SELECT mythology, list(name ORDER BY name) AS names FROM (SELECT DISTINCT mythology, name FROM m) d GROUP BY mythology)
  SELECT mythology, group_size, batch_no, array_to_string(members, '|') AS members,
         array_to_string(list_filter(names, lambda x: NOT list_contains(members, x))[1:60], '|') AS others
  FROM b JOIN n USING (mythology)""", ("fx_entities",))
def batch_groups(spark, sf):
    batches = ranking.batch_groups(entities(spark, sf), "mythology", "id", "name")
    return batches.withColumns({c: F.array_join(c, "|") for c in ("members", "others")})
