"""Search, text mining and question operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import text as text_functions
from kinweave.lineage import cut, spread
from kinweave.operators import mining, questions, search
from kinweave.plans.mining import mine_relations as mine_all
from kinweave.plans.mining import mined_pairs
from workload.entity_queries import NAME_INDEX, name_key
from workload.entity_queries import _index as name_index
from workload.graph_queries import entities, snapshot
from workload.registry import query
from workload.views import view


def quoted(text: str) -> str:
    return text.replace("'", "''")


INDEX_TOKENS = f"regexp_extract_all(translate(lower({{0}}), '{text_functions.ACCENTED}', '{text_functions.UNACCENTED}'), '[a-z0-9]+')"
QUERY_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda t: lower(t))[1:12]"

# --- search --------------------------------------------------------------------------------------


def _documents(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.lit("description").alias("field"), "text")


def _postings(spark, sf):
    """The index as a written table, as searches find it."""
    return cut(search.build_postings(_documents(spark, sf)))


def _searches(spark, sf):
    return view(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT item_id AS query_id, array_to_string({QUERY_TOKENS.format('text')}, ' ') AS tokens FROM benchmark")
def query_tokens(spark, sf):
    tokens = text_functions.query_tokens(F.col("text"))
    return _searches(spark, sf).select("query_id", F.array_join(tokens, " ").alias("tokens"))


FIELD_TEXTS = """texts AS (SELECT id AS doc_id, 'name' AS field, name AS text FROM fx_entities
  UNION ALL SELECT id, 'prototype', prototype FROM fx_entities
  UNION ALL SELECT id, 'description', description FROM fx_entities WHERE description <> ''
  UNION ALL SELECT id, 'mythology', mythology FROM fx_entities WHERE mythology <> ''
  UNION ALL SELECT id, 'aliases', alias FROM fx_aliases)"""


@query(f"""WITH {FIELD_TEXTS}, w AS (SELECT doc_id, field, unnest({INDEX_TOKENS.format('text')}) AS term FROM texts)
  SELECT term, field, doc_id, count(*) AS tf FROM w GROUP BY ALL""", ("fx_entities", "fx_aliases"))
def entity_postings(spark, sf):
    return search.build_postings(search.field_texts(entities(spark, sf), view(spark, sf, "fx_aliases")))


@query(f"""WITH w AS (SELECT doc_id, unnest({INDEX_TOKENS.format('text')}) AS term FROM documents)
  SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY term""")
def term_statistics(spark, sf):
    return search.term_statistics(search.build_postings(_documents(spark, sf)))


BM25 = f"""w AS (SELECT doc_id, unnest({INDEX_TOKENS.format('text')}) AS term FROM documents),
  post AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL),
  len AS (SELECT doc_id, sum(tf) AS length FROM post GROUP BY doc_id),
  corpus AS (SELECT count(*) AS docs, avg(length) AS mean FROM len),
  asked AS (SELECT query_id, token, count(*) AS times FROM (
    SELECT item_id AS query_id, unnest({QUERY_TOKENS.format('text')}) AS token FROM benchmark) t GROUP BY ALL),
  vocab AS (SELECT DISTINCT term FROM post),
  matched AS (SELECT token, term FROM (SELECT DISTINCT token FROM asked) a JOIN vocab ON starts_with(term, token)),
  hits AS (SELECT token, doc_id, sum(0.5 * tf)::DOUBLE AS f FROM matched JOIN post USING (term) GROUP BY ALL),
  found AS (SELECT token, count(*) AS n FROM hits GROUP BY token),
  parts AS (SELECT h.token, h.doc_id,
      CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END
      * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS part
    FROM hits h JOIN found USING (token) JOIN len USING (doc_id) CROSS JOIN corpus),
  scored AS (SELECT query_id, doc_id, round(sum(part * times), 9) AS score FROM asked JOIN parts USING (token) GROUP BY ALL),
  lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM scored) x
          WHERE nth <= 20)"""


RANKED = f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM lex"
#: The reference searches by so many tokens; queries named ``..._whole`` by all of them.
FIRST_TOKENS = 12


def whole_texts(sql):
    return sql.replace(QUERY_TOKENS.format("text"), QUERY_TOKENS.format("text").removesuffix("[1:12]"))


@query(RANKED)
def bm25_search(spark, sf):
    found = search.bm25_search(_searches(spark, sf), _postings(spark, sf), tokens=FIRST_TOKENS)
    return found.withColumn("score", F.round("score", 6))


@query(whole_texts(RANKED))
def bm25_search_whole(spark, sf):
    found = search.bm25_search(_searches(spark, sf), _postings(spark, sf))
    return found.withColumn("score", F.round("score", 6))


def _pieces(spark, sf):
    part = view(spark, sf, "part").select(F.substring(F.substring_index("p_name", " ", -1), 2, 3).alias("query_id")).distinct()
    return part.withColumn("text", F.col("query_id"))


@query(f"""WITH {FIELD_TEXTS}, q AS (SELECT DISTINCT substr(split_part(p_name, ' ', 2), 2, 3) AS query_id FROM part),
  terms AS (SELECT DISTINCT unnest({INDEX_TOKENS.format('text')}) AS term FROM texts),
  missed AS (SELECT query_id FROM q WHERE NOT EXISTS (SELECT 1 FROM terms WHERE starts_with(term, query_id)))
  SELECT query_id, doc_id, 10.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS nth FROM (
    SELECT DISTINCT query_id, doc_id FROM missed JOIN texts ON contains(lower(text), query_id) AND field IN ('name', 'aliases')) d) x
  WHERE nth <= 20""", ("fx_entities", "fx_aliases"))
def fallback_search(spark, sf):
    texts = search.field_texts(entities(spark, sf), view(spark, sf, "fx_aliases"))
    found = search.bm25_search(_pieces(spark, sf), search.build_postings(texts))
    return search.fallback_search(_pieces(spark, sf), found, texts)


@query("""SELECT p_partkey AS id, concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' xi la' ELSE ' bei 神' END, ' ', p_brand) AS spelled FROM part""")
def transliterate(spark, sf):
    tail = F.when(F.col("p_size") % 3 == 0, "希腊").otherwise("北神")
    texts = view(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", tail, "p_brand").alias("text"))
    mapping = spark.createDataFrame([("希", "xi"), ("腊", "la"), ("北", "bei")], "char string, spelling string")
    return search.transliterate(texts, mapping)


CENTROIDS = """dims AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  cen AS (SELECT label AS query_id, list(m ORDER BY pos) AS vector FROM (
    SELECT label, pos, avg(v) AS m FROM dims GROUP BY ALL) a GROUP BY label),
  cosines AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 9) AS score FROM cen CROSS JOIN embeddings),
  sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM cosines) x WHERE nth <= 20)"""


def _semantic(spark, sf):
    vectors = view(spark, sf, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(
        F.avg(F.col("v").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("d")).select(
        F.col("label").alias("query_id"), F.col("d.m").alias("vector"))
    return search.cosine_topk(centroids, vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query(f"WITH {CENTROIDS} SELECT query_id, id, round(score, 6) AS score FROM sem")
def cosine_topk(spark, sf):
    return _semantic(spark, sf).withColumn("score", F.round("score", 6))


FUSED = f"""WITH {BM25}, {CENTROIDS},
  l AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS lex FROM lex),
  fused AS (SELECT query_id, doc_id, round(0.6 * coalesce(lex, 0) + 0.4 * coalesce(greatest(score, 0), 0), 9) AS score
            FROM l FULL JOIN (SELECT query_id, id AS doc_id, score FROM sem) s USING (query_id, doc_id))
  SELECT query_id, doc_id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM fused) x WHERE nth <= 10"""


@query(FUSED)
def hybrid_search(spark, sf):
    lexical = search.bm25_search(_searches(spark, sf), _postings(spark, sf), tokens=FIRST_TOKENS)
    return search.hybrid_search(lexical, _semantic(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(whole_texts(FUSED))
def hybrid_search_whole(spark, sf):
    lexical = search.bm25_search(_searches(spark, sf), _postings(spark, sf))
    return search.hybrid_search(lexical, _semantic(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("""SELECT id, concat(name, '｜', coalesce(mythology, ''), '｜', prototype, '｜', description[1:200]) AS text,
                 (row_number() OVER (ORDER BY id) - 1) // 32 AS batch_no
          FROM fx_entities WHERE id NOT IN (SELECT 'c' || vec_id FROM embeddings WHERE label < 5)""", ("fx_entities",))
def embedding_worklist(spark, sf):
    model = F.when(F.col("label") < 5, "new").otherwise("old")
    stored = view(spark, sf, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("character_id"), model.alias("model"))
    return search.embedding_worklist(entities(spark, sf), stored, "new")


# --- sentences and tags --------------------------------------------------------------------------


def wiki_sql(expression: str) -> str:
    for pattern, value in text_functions.WIKI_MARKUP:
        expression = f"regexp_replace({expression}, '{quoted(pattern)}', '{value.replace('$', chr(92))}', 'g')"
    return strip_sql(expression)


def strip_sql(expression: str) -> str:
    return rf"regexp_replace({expression}, '^\s+|\s+$', '', 'g')"


SENTENCES = rf"""plain AS (SELECT doc_id, {wiki_sql('text')} AS text FROM documents),
  pieces AS (SELECT doc_id, regexp_split_to_array(text, '{text_functions.SENTENCE_END}') AS p FROM plain),
  listed AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS sentence_no, {strip_sql('unnest(p)')} AS text FROM pieces),
  sentences AS (SELECT doc_id * 1000000000000 + sentence_no AS sentence_id, doc_id, sentence_no, text FROM listed
                WHERE length(text) BETWEEN 12 AND 400)"""


def _sentences(spark, sf):
    pages = view(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), "text")
    pages = spread(pages, "page_id")
    found = mining.page_sentences(mining.page_sections(pages))
    return found.withColumn("sentence_id", F.col("page_id") * 10**12 + F.col("section_no") * 10**6 + F.col("sentence_no"))


@query(f"WITH {SENTENCES} SELECT sentence_id, doc_id, text FROM sentences")
def page_sentences(spark, sf):
    return _sentences(spark, sf).select("sentence_id", F.col("page_id").alias("doc_id"), "text")


# Entities named by the longer words of the benchmark texts; neighbouring words are known pairs.
WORDS = """bw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word,
                         generate_subscripts(regexp_extract_all(lower(text), '[a-z]{5,}'), 1) AS pos FROM benchmark),
  names AS (SELECT concat('d:', word) AS id, min(item_id) AS wiki_id, word AS name FROM bw GROUP BY word),
  known AS (SELECT a.item_id * 1000 + a.pos AS id, concat('d:', a.word) AS source_id, concat('d:', b.word) AS target_id,
                   CASE a.item_id % 2 WHEN 0 THEN 'ALLY_OF' ELSE 'ENEMY_OF' END AS type
            FROM bw a JOIN bw b ON a.item_id = b.item_id AND b.pos = a.pos + 1 WHERE a.word <> b.word)"""


def _words(spark, sf):
    return view(spark, sf, "benchmark").select("item_id", F.posexplode(
        F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"))).alias("pos", "word"))


def _named(spark, sf):
    return _words(spark, sf).groupBy("word").agg(F.min("item_id").alias("wiki_id")).select(
        F.concat(F.lit("d:"), "word").alias("id"), "wiki_id", F.col("word").alias("name"), F.lit("").alias("class_name"),
        F.lit("").alias("prototype"), F.lit("").alias("mythology"), F.lit("").alias("description"))


def _known(spark, sf):
    words = _words(spark, sf)
    following = words.select("item_id", (F.col("pos") - 1).alias("pos"), F.col("word").alias("next"))
    pairs = words.join(following, ["item_id", "pos"]).filter(F.col("word") != F.col("next"))
    return pairs.select(
        (F.col("item_id") * 1000 + F.col("pos") + 1).alias("id"), F.concat(F.lit("d:"), "word").alias("source_id"),
        F.concat(F.lit("d:"), "next").alias("target_id"),
        F.when(F.col("item_id") % 2 == 0, "ALLY_OF").otherwise("ENEMY_OF").alias("type"),
        F.lit("approved").alias("status"), F.lit("manual").alias("origin"))


def _no_aliases(spark, sf):
    return _named(spark, sf).select("id", F.col("name").alias("alias"))


TAGS = f"""runs AS (SELECT sentence_id, unnest(r) AS run, generate_subscripts(r, 1) - 1 AS pos FROM (
    SELECT sentence_id, regexp_extract_all(text, '{quoted(mining.NAME_RUN)}') AS r FROM sentences) t),
  begins AS (SELECT sentence_id, pos, run, unnest(generate_series(2, length(run))) AS size FROM runs WHERE length(run) >= 2),
  tagged AS (SELECT sentence_id, pos, id AS entity_id, run[1:size] AS match, size FROM begins
             JOIN names ON name = {name_key('run[1:size]')}),
  longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, pos ORDER BY size DESC) AS nth FROM tagged) x WHERE nth = 1),
  tags AS (SELECT sentence_id, entity_id, pos, match FROM (
             SELECT sentence_id, entity_id, pos, match, row_number() OVER (PARTITION BY sentence_id, entity_id ORDER BY pos) AS n2
             FROM longest) x WHERE n2 = 1)"""


def _tags(spark, sf, sentences):
    dictionary = mining.build_dictionary(_named(spark, sf), _no_aliases(spark, sf))
    return mining.tag_entities(sentences, dictionary)


@query(f"WITH {WORDS} SELECT name AS key, id FROM names")
def build_dictionary(spark, sf):
    return mining.build_dictionary(_named(spark, sf), _no_aliases(spark, sf))


@query(f"WITH {SENTENCES}, {WORDS}, {TAGS} SELECT sentence_id, entity_id, CAST(pos AS INT) AS pos, match FROM tags")
def tag_entities(spark, sf):
    return _tags(spark, sf, cut(_sentences(spark, sf).select("sentence_id", "text")))


# Names of two words, as they stand next to each other in the benchmark texts.
TWO_WORDS = f"""two AS (SELECT concat('t:', name) AS id, name FROM (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+ [a-z]+')) AS name FROM benchmark) t
    WHERE replace(name, ' ', '') NOT IN (SELECT name FROM names)),
  keyed AS (SELECT min(id) AS id, replace(name, ' ', '') AS key FROM two GROUP BY ALL),
  every_name AS (SELECT id, name AS key FROM names UNION ALL SELECT id, key FROM keyed),
  split AS (SELECT sentence_id, regexp_extract_all(text, '{quoted(mining.NAME_RUN)}') AS r,
                   regexp_split_to_array(text, '{quoted(mining.NAME_RUN)}') AS g FROM sentences),
  spans AS (SELECT sentence_id, pos, n, array_to_string(r[pos:pos + n - 1], ' ') AS match, r[pos] AS one, r[pos + n - 1] AS other
    FROM (SELECT *, unnest(range(2, least(9, len(r) - pos + 2))) AS n FROM (SELECT *, generate_subscripts(r, 1) AS pos FROM split))
    WHERE len(list_filter(g[pos + 1:pos + n - 1], lambda x: x <> ' ')) = 0),
  every AS (SELECT sentence_id, pos, pos AS last, id AS entity_id, run[1:size] AS match, length(key) AS size
      FROM begins JOIN every_name ON key = {name_key('run[1:size]')}
    UNION ALL SELECT sentence_id, pos - 1, pos + n - 2, id, match, length(key)
      FROM spans JOIN every_name ON key = {name_key('match')} WHERE {name_key('one')} <> '' AND {name_key('other')} <> ''),
  widest AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY pos) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY sentence_id, pos ORDER BY size DESC, last DESC, length(match) DESC) AS nth FROM every) x WHERE nth = 1),
  walk AS (SELECT sentence_id, k, pos, last AS until, entity_id, match, true AS kept FROM widest WHERE k = 1
    UNION ALL SELECT n.sentence_id, n.k, n.pos, CASE WHEN n.pos > w.until THEN n.last ELSE w.until END, n.entity_id, n.match, n.pos > w.until
      FROM walk w JOIN widest n ON n.sentence_id = w.sentence_id AND n.k = w.k + 1)"""


@query(f"""WITH RECURSIVE {SENTENCES}, {WORDS}, {TAGS}, {TWO_WORDS}
  SELECT sentence_id, entity_id, CAST(pos AS INT) AS pos, match FROM (
    SELECT *, row_number() OVER (PARTITION BY sentence_id, entity_id ORDER BY pos) AS first FROM walk WHERE kept) x WHERE first = 1""")
def tag_names(spark, sf):
    """Names of one word and of two in the sentences of the documents."""
    single = mining.build_dictionary(_named(spark, sf), _no_aliases(spark, sf))
    pairs = view(spark, sf, "benchmark").select(F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+ [a-z]+)"))).alias("name")).distinct()
    double = (pairs.select(F.replace("name", F.lit(" "), F.lit("")).alias("key"), F.concat(F.lit("t:"), "name").alias("id"))
              .groupBy("key").agg(F.min("id").alias("id")).join(single, "key", "left_anti"))
    return mining.tag_names(_sentences(spark, sf), single.select("key", "id").unionByName(double))


COMENTIONS = f"""lists AS (SELECT sentence_id, count(*) AS n, array_to_string(list_sort(list(entity_id)), '|') AS ids FROM tags
                          GROUP BY sentence_id HAVING count(*) >= 2),
  com AS (SELECT sentence_id, text, n, ids, doc_id FROM (SELECT l.*, s.text, s.doc_id, row_number() OVER (
            PARTITION BY {name_key('s.text')}, ids ORDER BY l.sentence_id) AS nth FROM lists l JOIN sentences s USING (sentence_id)) x
          WHERE nth = 1)"""


def _comentions(spark, sf):
    sentences = cut(_sentences(spark, sf).select("sentence_id", "title", "text"))
    return mining.comention_sentences(sentences, _tags(spark, sf, sentences))


@query(f"WITH {SENTENCES}, {WORDS}, {TAGS}, {COMENTIONS} SELECT sentence_id, text, ids FROM com")
def comention_sentences(spark, sf):
    ids = F.array_join(F.array_sort(F.transform("entities", lambda e: e["id"])), "|")
    return _comentions(spark, sf).select("sentence_id", "text", ids.alias("ids"))


def between_sql(x: str, y: str) -> str:
    """Words between each occurrence of one name and the next occurrence of the other within reach."""
    return f"""list_transform(flatten(list_transform(list_filter(list_transform(list_filter(
        generate_series(1, length(text)), lambda i: substr(text, i, length({x})) = {x}),
        lambda i: [i + length({x}), CASE WHEN strpos(substr(text, i + length({x})), {y}) > 0
                   THEN i + length({x}) - 1 + strpos(substr(text, i + length({x})), {y}) ELSE 0 END]),
        lambda g: g[2] > 0 AND g[2] - g[1] <= 60),
        lambda g: regexp_extract_all(substr(text, g[1], g[2] - g[1]), '{mining.CONNECTOR[1:-1]}'))), lambda w: lower(w))"""


PAIRS = f"""pairs AS (SELECT c.sentence_id, c.text, c.doc_id, a.entity_id AS a_id, a.match AS a_match, b.entity_id AS b_id, b.match AS b_match
    FROM com c JOIN tags a USING (sentence_id) JOIN tags b ON b.sentence_id = a.sentence_id AND b.pos > a.pos),
  worded AS (SELECT *, list_concat({between_sql('a_match', 'b_match')}, {between_sql('b_match', 'a_match')}) AS words FROM pairs)"""
MINED = f"{SENTENCES}, {WORDS}, {TAGS}, {COMENTIONS}, {PAIRS}"


def _pairs(spark, sf):
    return mined_pairs(_sentences(spark, sf), _named(spark, sf), _no_aliases(spark, sf))


@query(f"WITH {MINED} SELECT sentence_id, a_id, b_id, a_match, b_match, array_to_string(words, ' ') AS words FROM worded")
def connector_words(spark, sf):
    return _pairs(spark, sf).select("sentence_id", "a_id", "b_id", "a_match", "b_match", F.array_join("words", " ").alias("words"))


STOPS = ", ".join(f"'{w}'" for w in vocab.TRIGGER_STOP_WORDS)
GIVEN = ", ".join(f"('{t}', '{w}', {i})" for i, (t, words) in enumerate(vocab.TRIGGER_WORDS.items()) for w in words)
TRIGGERS = f"""seeds AS (SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, max_by(type, id) AS type
                       FROM known GROUP BY ALL),
  seen AS (SELECT s.type, unnest(words) AS word FROM worded JOIN seeds s ON lo = least(a_id, b_id) AND hi = greatest(a_id, b_id)),
  learned AS (SELECT type, word, count(*) AS times FROM seen WHERE length(word) >= 3 AND word NOT IN ({STOPS})
                AND word NOT IN (SELECT name FROM names) GROUP BY ALL HAVING count(*) >= 3),
  given AS (SELECT * FROM (VALUES {GIVEN}) v(type, word, rank)),
  triggers AS (SELECT type, word, max(times) AS times FROM (SELECT type, word, times FROM learned UNION ALL SELECT type, word, 0 FROM given) u
               GROUP BY ALL)"""


def _triggers(spark, sf, pairs):
    seeds = mining.seed_pairs(_named(spark, sf), _known(spark, sf))
    return mining.learn_triggers(pairs, seeds, _named(spark, sf))


@query(f"WITH {MINED}, {TRIGGERS} SELECT type, word, times FROM triggers")
def learn_triggers(spark, sf):
    return _triggers(spark, sf, _pairs(spark, sf))


@query(f"""WITH {MINED}, {TRIGGERS},
  ranks AS (SELECT DISTINCT type, rank FROM given),
  w AS (SELECT DISTINCT sentence_id, a_id, b_id, unnest(words) AS word FROM worded),
  h AS (SELECT sentence_id, a_id, b_id, type, count(*) AS hits, array_to_string((list_sort(list(word)))[1:4], '|') AS triggers
        FROM w JOIN triggers USING (word) GROUP BY sentence_id, a_id, b_id, type),
  b AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY sentence_id, a_id, b_id ORDER BY hits DESC, rank) AS nth
                       FROM h JOIN ranks USING (type)) x WHERE nth = 1),
  e AS (SELECT b.sentence_id, least(b.a_id, b.b_id) AS source_id, greatest(b.a_id, b.b_id) AS target_id, b.type, hits, triggers,
               '[' || d.source || '] ' || c.text[1:180] AS evidence
        FROM b JOIN com c USING (sentence_id) JOIN documents d ON d.doc_id = c.doc_id),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY sentence_id) AS nth FROM e) x WHERE nth = 1)
  SELECT sentence_id, source_id, target_id, type, hits, triggers, evidence FROM f WHERE NOT EXISTS (SELECT 1 FROM known k
    WHERE k.type = f.type AND least(k.source_id, k.target_id) = f.source_id AND greatest(k.source_id, k.target_id) = f.target_id)""")
def relation_candidates(spark, sf):
    pairs = _pairs(spark, sf)
    found = mining.relation_candidates(pairs, _triggers(spark, sf, pairs), _known(spark, sf))
    return found.withColumn("triggers", F.array_join("triggers", "|"))


@query()
def mine_relations(spark, sf):
    found = mine_all(_pairs(spark, sf), _named(spark, sf), _no_aliases(spark, sf), _known(spark, sf))
    return mining.pending_edges(found)


# The texts hold no kinship words, so sentences are made of part names.
KIN = """kin AS (SELECT l_orderkey * 1000000 + pos AS sentence_id, concat('c', l_partkey) AS a_id, concat('c', nxt) AS b_id,
    concat('part', l_partkey) AS a_match, concat('part', nxt) AS b_match, concat('order ', l_orderkey) AS title, l_linenumber AS line
  FROM fx_items WHERE nxt IS NOT NULL AND nxt <> l_partkey)"""


@query(f"""WITH {KIN}, e AS (SELECT sentence_id, CASE WHEN line IN (1, 4) THEN a_id ELSE b_id END AS source_id,
    CASE WHEN line IN (1, 4) THEN b_id ELSE a_id END AS target_id,
    CASE line WHEN 3 THEN 'MENTOR_OF' ELSE 'PARENT_OF' END AS type FROM kin WHERE line <= 4)
  SELECT sentence_id, source_id, target_id, type FROM (SELECT *, row_number() OVER (
    PARTITION BY least(source_id, target_id), greatest(source_id, target_id), type ORDER BY sentence_id, source_id) AS nth FROM e) f
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM sq_edges k WHERE k.type = f.type
    AND least(k.source_id, k.target_id) = least(f.source_id, f.target_id)
    AND greatest(k.source_id, k.target_id) = greatest(f.source_id, f.target_id))""", ("fx_items", "sq_edges"))
def template_candidates(spark, sf):
    items = view(spark, sf, "fx_items").filter(F.col("nxt").isNotNull() & (F.col("nxt") != F.col("l_partkey")))
    a, b, line = F.concat(F.lit("part"), "l_partkey"), F.concat(F.lit("part"), "nxt"), F.col("l_linenumber")
    text = (F.when(line == 1, F.concat(a, F.lit(" was the lord and father of "), b))
            .when(line == 2, F.concat(a, F.lit("'s beloved mother, "), b))
            .when(line == 3, F.concat(a, F.lit("的老师是"), b))
            .when(line == 4, F.concat(a, F.lit("'s eldest daughter "), b))
            .otherwise(F.concat(a, F.lit(" met "), b)))
    pairs = items.select((F.col("l_orderkey") * 1_000_000 + F.col("pos")).alias("sentence_id"), text.alias("text"),
                         F.concat(F.lit("order "), "l_orderkey").alias("title"), F.concat(F.lit("c"), "l_partkey").alias("a_id"),
                         F.concat(F.lit("c"), "nxt").alias("b_id"), a.alias("a_match"), b.alias("b_match"))
    found = mining.template_candidates(pairs, snapshot(spark, sf))
    return found.select("sentence_id", "source_id", "target_id", "type")


# --- questions -----------------------------------------------------------------------------------

ASKED = """asked AS (SELECT conv_id * 1000 + turn AS query_id, concat(text, CASE turn % 4 WHEN 0 THEN ' 显示希腊神话里的父子关系'
    WHEN 1 THEN ' 北欧的敌对关系和配偶' WHEN 2 THEN ' Saber和剑阶女性' ELSE ' 日本神话的师徒关系，相关' END) AS text FROM conversations)"""


def _asked(spark, sf):
    turn = F.col("turn") % 4
    tail = (F.when(turn == 0, " 显示希腊神话里的父子关系").when(turn == 1, " 北欧的敌对关系和配偶")
            .when(turn == 2, " Saber和剑阶女性").otherwise(" 日本神话的师徒关系，相关"))
    return view(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                                                   F.concat("text", tail).alias("text"))


CLASS_HITS = ", ".join(f"CASE WHEN contains(lower(text), '{c.lower()}') THEN '{vocab.CLASS_SHORT_NAMES.get(c, c)}' END"
                       for c in (*vocab.CLASS_NAMES, *vocab.CLASS_SHORT_NAMES))
TAGGED = f"""{ASKED}, tq AS (SELECT query_id,
    CASE WHEN contains(text, '希腊') THEN '希腊神话' WHEN contains(text, '北欧') THEN '北欧神话' WHEN contains(text, '日本') THEN '日本神话' ELSE '' END AS mythologies,
    CASE WHEN contains(text, '父子') THEN 'PARENT_OF' WHEN contains(text, '敌对') THEN 'SPOUSE_OF|ENEMY_OF' WHEN contains(text, '师徒') THEN 'MENTOR_OF' ELSE '' END AS types,
    array_to_string(list_filter([{CLASS_HITS}], lambda c: c IS NOT NULL), '|') AS classes,
    CASE WHEN contains(text, '女性') THEN '女' END AS gender, contains(text, '相关') AS only_related FROM asked)"""


@query(f"WITH {TAGGED} SELECT * FROM tq")
def tag_queries(spark, sf):
    tagged = questions.tag_queries(_asked(spark, sf)).drop("explanation")
    return tagged.withColumns({c: F.array_join(c, "|") for c in ("mythologies", "types", "classes")})


@query(f"""WITH {TAGGED} SELECT query_id, mythologies, CASE WHEN types = '' THEN 'ALLY_OF' ELSE types END AS types,
    coalesce(gender, '男') AS gender, only_related OR conv_id % 2 = 0 AS only_related, role AS search
  FROM tq JOIN conversations ON query_id = conv_id * 1000 + turn""")
def merge_filters(spark, sf):
    none = F.array().cast("array<string>")
    others = view(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), none.alias("mythologies"), F.array(F.lit("ALLY_OF")).alias("types"),
        none.alias("classes"), F.lit("男").alias("gender"), (F.col("conv_id") % 2 == 0).alias("only_related"),
        F.col("role").alias("search"), F.lit("").alias("explanation"))
    merged = questions.merge_filters(questions.tag_queries(_asked(spark, sf)), others)
    return merged.select("query_id", F.array_join("mythologies", "|").alias("mythologies"), F.array_join("types", "|").alias("types"),
                         "gender", "only_related", "search")


@query("""SELECT event_id AS reply_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract(props, '$.k') AS INT) ELSE -1 END AS k,
                 event_id % 5 = 4 AS bad FROM events""")
def parse_structured(spark, sf):
    kind = F.col("event_id") % 5
    raw = (F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
           .when(kind == 2, F.concat(F.lit("<think>a\nb</think> "), "props")).when(kind == 3, F.concat(F.lit("<think>"), "props"))
           .otherwise(F.concat(F.lit("sorry "), "props")))
    replies = view(spark, sf, "events").select(F.col("event_id").alias("reply_id"), raw.alias("raw"))
    return questions.parse_structured(replies, "k int").select(
        "reply_id", F.coalesce("parsed.k", F.lit(-1)).alias("k"), "bad")


@query(f"""WITH {NAME_INDEX},
  ends AS (SELECT r.*, s.id AS s_id, t.id AS t_id, trim(relationship) AS given FROM fx_raw_edges r
           JOIN idx s ON s.name = trim(source_name) JOIN idx t ON t.name = trim(target_name)),
  turned AS (SELECT *, CASE given WHEN 'CHILD_OF' THEN 'PARENT_OF' WHEN 'STUDENT_OF' THEN 'MENTOR_OF'
                                  WHEN 'SERVANT_OF' THEN 'MASTER_OF' ELSE given END AS type,
                    CASE WHEN given IN ('CHILD_OF', 'STUDENT_OF', 'SERVANT_OF') THEN t_id ELSE s_id END AS source_id,
                    CASE WHEN given IN ('CHILD_OF', 'STUDENT_OF', 'SERVANT_OF') THEN s_id ELSE t_id END AS target_id
             FROM ends WHERE s_id <> t_id AND given <> 'UNKNOWN_OF'),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id), type
                       ORDER BY seq) AS nth FROM turned) x WHERE nth = 1)
  SELECT source_id, target_id, type, CASE WHEN confidence IN ('high', 'medium', 'low') THEN confidence ELSE 'medium' END AS confidence,
         evidence[1:200] AS evidence
  FROM f WHERE NOT EXISTS (SELECT 1 FROM sq_edges e WHERE e.type = f.type
    AND least(e.source_id, e.target_id) = least(f.source_id, f.target_id)
    AND greatest(e.source_id, e.target_id) = greatest(f.source_id, f.target_id))""",
       ("fx_raw_edges", "fx_entities", "fx_aliases", "sq_edges"))
def candidates_to_edges(spark, sf):
    made = questions.candidates_to_edges(view(spark, sf, "fx_raw_edges"), name_index(spark, sf), snapshot(spark, sf))
    return made.select("source_id", "target_id", "type", "confidence", "evidence")


def _questions(spark, sf):
    talk = view(spark, sf, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    talk = spread(talk, "question_id")
    return talk.unionByName(view(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("question_id"), "text"))


@query(f"""WITH {WORDS}, q AS (SELECT conv_id * 1000 + turn AS text_id, text FROM conversations WHERE role = 'user'
                              UNION ALL SELECT -1 - item_id, text FROM benchmark)
  SELECT text_id, name AS needle FROM q JOIN names ON contains(text, name)""")
def contained_names(spark, sf):
    texts = _questions(spark, sf).withColumnRenamed("question_id", "text_id")
    return search.contained_needles(texts, _named(spark, sf).select(F.col("name").alias("needle")))


@query()
def link_entities(spark, sf):
    named = _named(spark, sf)
    texts = cut(search.field_texts(named, _no_aliases(spark, sf)))
    return questions.link_entities(_questions(spark, sf), named, cut(search.build_postings(texts)), texts=texts)


def _linked(spark, sf):
    pairs = view(spark, sf, "fx_pairs")
    first = pairs.select(F.col("source").alias("question_id"), F.col("source").alias("entity_id"), F.lit(1).alias("rank"))
    return first.union(pairs.select("source", "target", F.lit(2)))


NEAR = """seen AS (SELECT source_id AS src, target_id AS dst, id, type, confidence FROM sq_edges
                 UNION ALL SELECT target_id, source_id, id, type, confidence FROM sq_edges),
  near AS (SELECT src, dst, nth, name, type, confidence, CASE type WHEN 'PARENT_OF' THEN '父母' WHEN 'ALLY_OF' THEN '盟友' ELSE '师傅' END AS label
           FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY id, dst) AS nth FROM seen {where}) s JOIN fx_entities e ON e.id = dst
           WHERE nth <= {k})"""


@query("WITH l AS (SELECT source AS question_id, source AS id, 1 AS rank FROM fx_pairs UNION ALL SELECT source, target, 2 FROM fx_pairs),"
       + NEAR.format(where="", k=8) + """,
  lines AS (SELECT src, string_agg('  —' || label || '→ ' || name || '（置信度 ' || confidence || '）', chr(10) ORDER BY nth) AS body,
                   list(dst ORDER BY nth) AS cited, count(*) AS n FROM near GROUP BY src),
  t AS (SELECT question_id, rank, '◆ ' || name || '（' || coalesce(nullif(mythology, ''), '体系未知') || '｜' || class_name || '）'
          || CASE WHEN description <> '' THEN chr(10) || '  ' || description[1:120] ELSE '' END
          || CASE WHEN body IS NULL THEN chr(10) || '  （暂无已审核的角色间关系）'
                  ELSE chr(10) || body || CASE WHEN n >= 8 THEN chr(10) || '  …（更多关系见图谱）' ELSE '' END END AS text,
          coalesce(cited, []) AS cited
        FROM l JOIN fx_entities e ON e.id = l.id LEFT JOIN lines ON src = l.id)
  SELECT question_id, string_agg(text, chr(10) ORDER BY rank) AS context,
         array_to_string((flatten(list(cited ORDER BY rank)))[1:30], '|') AS citations FROM t GROUP BY question_id""",
       ("fx_pairs", "sq_edges", "fx_entities"))
def question_contexts(spark, sf):
    found = questions.question_contexts(_linked(spark, sf), entities(spark, sf), snapshot(spark, sf))
    return found.withColumn("citations", F.array_join("citations", "|"))


@query("WITH l AS (SELECT source AS question_id, source AS id, 1 AS rank FROM fx_pairs UNION ALL SELECT source, target, 2 FROM fx_pairs),"
       + NEAR.format(where="", k=8) + """,
  lines AS (SELECT src, string_agg('  —' || label || '→ ' || name || '（置信度 ' || confidence || '）', chr(10) ORDER BY nth) AS body,
                   string_agg(dst || ':' || name || ':' || type, '|' ORDER BY nth) AS cited, count(*) AS n FROM near GROUP BY src),
  t AS (SELECT question_id, rank, '◆ ' || name || '（' || coalesce(nullif(mythology, ''), '体系未知') || '｜' || class_name || '）'
          || CASE WHEN description <> '' THEN chr(10) || '  ' || description[1:120] ELSE '' END
          || CASE WHEN body IS NULL THEN chr(10) || '  （暂无已审核的角色间关系）'
                  ELSE chr(10) || body || CASE WHEN n >= 8 THEN chr(10) || '  …（更多关系见图谱）' ELSE '' END END AS text, cited
        FROM l JOIN fx_entities e ON e.id = l.id LEFT JOIN lines ON src = l.id),
  known AS (SELECT question_id, string_agg(text, chr(10) ORDER BY rank) AS context, string_agg(cited, '|' ORDER BY rank) AS citations
            FROM t GROUP BY question_id)
  SELECT question_id, coalesce(context, '""" + questions.NO_ENTITY.replace("'", "''") + """') AS context, coalesce(citations, '') AS citations
  FROM (SELECT DISTINCT source AS question_id FROM fx_pairs UNION SELECT 'b' || item_id FROM benchmark
        UNION SELECT 'v' || conv_id FROM conversations) q LEFT JOIN known USING (question_id)""",
       ("fx_pairs", "sq_edges", "fx_entities"))
def question_answers(spark, sf):
    asked = view(spark, sf, "fx_pairs").select(F.col("source").alias("question_id"))
    for name, mark, key in (("benchmark", "b", "item_id"), ("conversations", "v", "conv_id")):
        asked = asked.union(view(spark, sf, name).select(F.concat(F.lit(mark), key)))
    found = questions.question_answers(asked, _linked(spark, sf), entities(spark, sf), snapshot(spark, sf))
    return found.withColumn("citations", F.array_join(
        F.transform("citations", lambda c: F.concat_ws(":", c["id"], c["name"], c["relation"])), "|"))


@query("""WITH l AS (SELECT source AS question_id, source AS id FROM fx_pairs UNION SELECT source, target FROM fx_pairs),
  r AS (SELECT * FROM l UNION SELECT question_id, dst FROM l JOIN sq_neighbors ON id = src)
  SELECT question_id, id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id) AS nth FROM r) x WHERE nth <= 60""",
       ("fx_pairs", "sq_neighbors"))
def question_subgraphs(spark, sf):
    return questions.question_subgraphs(_linked(spark, sf), entities(spark, sf), snapshot(spark, sf))


@query("WITH " + NEAR.format(where="WHERE type IN ('ALLY_OF', 'MASTER_OF')", k=4) + """,
  c AS (SELECT e.id, e.name, e.name || '：' || class_name || '，' || coalesce(nullif(mythology, ''), '体系未知') || '，' || description[1:80] AS line,
               coalesce(allies, '') AS allies
        FROM fx_entities e LEFT JOIN (SELECT src, string_agg(name, '|' ORDER BY nth) AS allies FROM near GROUP BY src) a ON src = e.id)
  SELECT source AS a_id, target AS b_id, '⚔️ ' || a.name || ' VS ' || b.name || chr(10) || a.line || chr(10) || b.line AS card,
         a.allies AS a_allies, b.allies AS b_allies FROM fx_pairs JOIN c a ON a.id = source JOIN c b ON b.id = target""",
       ("fx_pairs", "sq_edges", "fx_entities"))
def pair_profiles(spark, sf):
    pairs = view(spark, sf, "fx_pairs").select(F.col("source").alias("a_id"), F.col("target").alias("b_id"))
    cards = questions.pair_profiles(pairs, entities(spark, sf), snapshot(spark, sf))
    return cards.withColumns({c: F.array_join(c, "|") for c in ("a_allies", "b_allies")})


@query("""SELECT id, concat_ws('|', '职阶：' || class_name, '神话体系：' || mythology, '性别：' || nullif(gender, ''),
            '原型名字里含有「' || prototype[1:1] || '」字', CASE WHEN description <> '' THEN '简介片段：' || description[1:50] || '…' END) AS facts
          FROM fx_entities""", ("fx_entities",))
def entity_facts(spark, sf):
    return questions.entity_facts(entities(spark, sf)).withColumn("facts", F.array_join("facts", "|"))
