"""Plans: no pairing of everything with everything, filters and columns pushed into the scan."""

import re

import pytest

from kinweave import vocab
from kinweave.operators import edges, harvest, listing, mining, search, stats
from workload import entity_queries, graph_queries, source_queries, text_queries
from workload.check import DATA

SF = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [
    graph_queries.graph_snapshot, graph_queries.degree, graph_queries.subgraph_nodes, graph_queries.incident_edges,
    graph_queries.shortest_paths, graph_queries.suggest_links, graph_queries.validate_chains, graph_queries.quality_stats,
    graph_queries.deterministic_pick, entity_queries.resolve_edges, entity_queries.resolve_mentions, entity_queries.match_entities,
    entity_queries.prototype_match, entity_queries.intake, text_queries.tag_entities, text_queries.bm25_search,
    text_queries.contained_names, text_queries.link_entities, text_queries.cosine_topk, text_queries.relation_candidates,
], ids=lambda q: q.__name__)
def test_no_nested_loops(spark, query):
    text = plan(query(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    graph_queries.relationships(spark, SF).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    text = plan(listing.count_edges(stored, status="approved", origin="manual"))
    assert "EqualTo(status,approved)" in text and "EqualTo(origin,manual)" in text
    scan = [line for line in text.splitlines() if "FileScan" in line][0]
    assert "evidence" not in scan and "source_id" not in scan


def test_first_per_key_combines_before_the_shuffle(spark):
    text = plan(edges.canonical_edges(graph_queries.relationships(spark, SF)))
    assert text.count("partial_min_by") >= 1


def test_each_different_run_is_looked_up_once(spark, monkeypatch):
    written, cut = [], mining.cut
    monkeypatch.setattr(mining, "cut", lambda df: written.append(cut(df)) or written[-1])
    sentences = spark.createDataFrame([(i, f"Saber met Lancer {i}") for i in range(50)], "sentence_id int, text string")
    names = spark.createDataFrame([("saber", "s"), ("lancer", "l")], "key string, id string")
    assert mining.tag_entities(sentences, names).count() == 100
    assert sorted(map(tuple, written[-1].collect())) == [("Lancer", "l", "Lancer"), ("Saber", "s", "Saber")]


def test_templates_share_the_marked_texts(spark):
    pairs = spark.createDataFrame([], "sentence_id int, title string, text string, a_id string, b_id string, a_match string, b_match string")
    known = spark.createDataFrame([], "source_id string, target_id string, type string")
    text = mining.template_candidates(pairs, known)._jdf.queryExecution().optimizedPlan().toString()
    # Two replacements for either order of the lengths, on both sides.
    assert text.count("regexp_replace(text") <= 4


def test_postings_shuffle_texts_not_terms(spark):
    texts = spark.createDataFrame([], "doc_id string, field string, text string")
    text = plan(search.build_postings(texts))
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")


def test_index_pages_of_one_file_are_spread_before_they_are_parsed(spark):
    text = plan(source_queries.extract_index_rows(spark, SF))
    assert text.index("Generate") < text.index("Exchange hashpartitioning(p_partkey")


def test_selections_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    chosen = spark.range(2000).selectExpr("id % 100 AS user_id", "concat('e', id) AS id")
    known = spark.range(2000).selectExpr("concat('e', id) AS id", "concat('e', id) AS name", f"if(id = 0, '{vocab.PROTOTYPE_CLASS}', 'K') AS class_name", "'M' AS mythology")
    edges_of = spark.createDataFrame([(1, "e9", "e0", "DERIVED_FROM")], "id long, source_id string, target_id string, type string")
    monkeypatch.setattr(stats, "TASK_ROWS", 100, raising=False)
    for query in (stats.selection_prototypes, stats.selection_profile):
        text = plan(query(chosen, known, edges_of))
        assert re.search(r"hashpartitioning\(user_id#\d+L?, 20\)", text), query.__name__


def test_hits_are_rated_once(spark, monkeypatch):
    written, cut = [], harvest.cut
    monkeypatch.setattr(harvest, "cut", lambda df: written.append(cut(df)) or written[-1])
    text = plan(entity_queries.resolve_prototypes(spark, SF))
    assert any("exact" in df.columns for df in written) and "lineitem" not in text


def test_names_of_one_shard_are_settled_where_they_are_found(spark):
    sentences = spark.createDataFrame([(1, "King Arthur met Arthur"), (2, "aß İb-c.d")], "sentence_id int, text string")
    names = spark.createDataFrame([("kingarthur", "k"), ("arthur", "a"), ("aßi̇bc", "b")], "key string, id string")
    tags = mining.tag_names(sentences, names)
    assert plan(tags).count("Exchange") == 2
    assert sorted((t.sentence_id, t.pos, t.entity_id, t.match) for t in tags.collect()) == [(1, 0, "k", "King Arthur"), (1, 3, "a", "Arthur")]


def test_report_reads_the_rated_hits(spark, monkeypatch):
    dealt, spread = [], harvest.spread
    monkeypatch.setattr(harvest, "spread", lambda df, key: dealt.append(spread(df, key)) or dealt[-1])
    assert "lineitem" not in plan(entity_queries.match_report(spark, SF))
    assert dealt[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_figures_of_a_build_read_what_it_wrote(spark):
    text = plan(source_queries.build_all_figures(spark, SF))
    assert "lineitem" not in text and "orders" not in text
