"""The registered queries of these operators, with their SQL checks where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.lineage import step_path
from kinweave.llm import (ann, bpe, chat, decontaminate, licenses, merkle, near_dup, packing, pii, quality, repair,
                          token_store, toxicity)
from kinweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


@query()
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = step_path(spark, "tokens")
    token_store.write_token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_store.token_index(spark, path)


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity=0.85)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), part AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, list_slice(words, s, s + least(len(words), 10) - 1) AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item WHERE len(words) > 0)
), gram AS (
  SELECT doc_id, s, size, list_slice(words, s, s + size - 1) AS gram
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s
        FROM doc, (SELECT DISTINCT size FROM part) WHERE len(words) >= size)
), hit AS (
  SELECT doc_id, item_id, s, gram.size FROM gram JOIN part USING (gram)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _pii_sql() -> str:
    """Gaps and matches of each kind, with the plain patterns; the checks spelled out in SQL."""
    luhn = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT " \
           "WHEN substr(reverse(d), i, 1)::INT * 2 > 9 THEN substr(reverse(d), i, 1)::INT * 2 - 9 " \
           "ELSE substr(reverse(d), i, 1)::INT * 2 END)) % 10 = 0"
    moved = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, len({moved}) + 1), " \
            f"lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({moved}, i, 1)) - 1)), " \
            "lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"
    octets = "len(list_filter(string_split(v, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL OR try_cast(p AS HUGEINT) > 255)) = 0"
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", octets),
             ("card", r"[0-9]([\x20-]?[0-9])+", f"len(d) BETWEEN 13 AND 19 AND {luhn}"),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 9 AND 15"),
             ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", mod97)]
    def score(kind: pii.Kind) -> str:
        word, width = kind.context.replace("'", "''"), pii.CONTEXT_CHARS
        return f"CASE WHEN regexp_matches(substr(text, greatest(s - {width}, 0)::BIGINT + 1, least(s, {width})::BIGINT), '{word}') " \
               f"OR regexp_matches(substr(text, e::BIGINT + 1, {width}), '{word}') THEN {kind.raised} ELSE {kind.score} END::DOUBLE"

    parts = [f"""SELECT doc_id, {rank} AS rank, '{name}' AS kind, s, e, {score(pii.KINDS[rank])} AS score FROM (
        SELECT doc_id, text, v, regexp_replace(v, '[^0-9]', '', 'g') AS d,
               before + sum(len(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - len(v) AS s,
               before + sum(len(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e
        FROM (SELECT doc_id, text, i, hits[i] AS v, sum(len(gaps[i])) OVER (PARTITION BY doc_id ORDER BY i) AS before
              FROM (SELECT doc_id, text, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
                SELECT doc_id, text, string_split_regex(text, '{pattern}') AS gaps,
                       regexp_extract_all(text, '{pattern}') AS hits FROM docs)))) WHERE {check}"""
             for rank, (name, pattern, check) in enumerate(kinds)]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "iban"))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), span AS ({" UNION ALL ".join(parts)}),
per AS (SELECT doc_id, {counts},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 4) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans,
  string_agg(round(score * 100)::INT::VARCHAR, ',' ORDER BY rank, s) AS scores, max(score) AS score FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_iban, 0) AS n_iban, coalesce(scores, '') AS scores, coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN per USING (doc_id)"""


@query(_pii_sql())
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_pii(table(spark, sf_dir, "documents")))


#: Control strings of the chat format, spelled for SQL.
TAIL_SQL = r"\|[^|<>\n]{0,40}\|>|/?s>|/?<?/?SYS>>|/?INST\]|/?unk>|/?pad>"
PLANTED_CHAT = "</s>[INST] ok [/INST]"


@query(rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED_CHAT}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED_CHAT}'
), shown AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)({TAIL_SQL})', '\1\\\2\3', 'g') AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, escaped)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, escaped) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + len(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + len(escaped))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
""")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED_CHAT), (-1, 1, "assistant", PLANTED_CHAT)], rows.schema)
    # Each text comes in two parts, so a control string can begin in one and end in the other.
    text, middle = F.coalesce("text", F.lit("")), F.floor(F.length("text") / 2)
    parts = chat.text_part(F.left(text, F.coalesce(middle, F.lit(0)).cast("int")), F.substr(text, F.coalesce(middle + 1, F.lit(1)).cast("int")))
    turns = rows.union(planted).withColumn("parts", parts).drop("text")
    return chat.chat_digests(chat.read_back(chat.format_chats(turns)))


def _license_sql() -> str:
    templates = ", ".join(f"({i}, '{t.licence}', '{t.text.replace(chr(39), chr(39) * 2)}')"
                          for i, t in enumerate(licenses.TEMPLATES))
    def grams(text: str) -> str:
        words = rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
                r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
        return f"list_distinct(list_transform(list_zip(({words})[:-2], ({words})[2:]), lambda p: p[1] || ' ' || p[2]))"
    return f"""
WITH lines AS (SELECT doc_id, text, string_split_regex(coalesce(text, ''), '\\r?\\n|\\r') AS l FROM documents),
unit AS (SELECT doc_id, k, {grams('u')} AS grams FROM (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS u FROM lines
  UNION ALL SELECT doc_id, 0, text FROM lines WHERE len(l) > 1)),
template AS (SELECT i, licence, {grams('t')} AS grams FROM (VALUES {templates}) AS v(i, licence, t)),
met AS (SELECT doc_id, k, i, licence, 2::DOUBLE * count(*) / (any_value(len(u.grams)) + any_value(len(t.grams))) AS dice
  FROM (SELECT doc_id, k, grams, unnest(grams) AS gram FROM unit) u
  JOIN (SELECT i, licence, grams, unnest(grams) AS gram FROM template) t USING (gram) GROUP BY doc_id, k, i, licence),
hit AS (SELECT doc_id, list_sort(list(DISTINCT licence)) AS licences, arg_min(licence, (-dice, licence)) AS best, max(dice) AS score
  FROM met WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id)
SELECT doc_id, len(l) AS n_units, coalesce(array_to_string(licences, ','), '') AS licences, best, coalesce(score, 0) AS score
FROM lines LEFT JOIN hit USING (doc_id)"""


@query(_license_sql())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licences", F.array_join("licences", ","))


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality.fold(F.col("doc_id"), 4) == 2
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (quality.score_quality(docs, model)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality.fold(F.col("doc_id"), 5) == 0
    grammar = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (toxicity.score_toxicity(docs, grammar)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query()
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of ASCII text: each byte is taken in, then eight shifts by one bit (marked -1)."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: " \
            f"[ascii(substr({text}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) " \
           "WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"


def leaf_sql(text: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


@query(f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf_sql('text')} AS leaf, {leaf_sql('changed')} AS tampered
  FROM (SELECT *, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
        FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM doc
), lower_tree AS (
  SELECT tree, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM lower_tree WHERE n > 1 GROUP BY tree, level, place // 3
), subroot AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS level, place, digest, n FROM subroot
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM upper_tree WHERE n > 1 GROUP BY level, place // 3
), node AS (
  SELECT tree, level, place, digest FROM lower_tree WHERE n > 1
  UNION ALL
  SELECT s.tree, l.levels + u.level, u.place, u.digest
  FROM subroot s, (SELECT tree, max(level) AS levels FROM lower_tree GROUP BY tree) l, upper_tree u
  WHERE s.tree = l.tree AND u.n > 1
), start AS (
  SELECT p.tree, p.place AS row, d.digest, s.place AS place_of_tree, (SELECT max(level) FROM lower_tree l WHERE l.tree = p.tree) AS levels,
         p.tampered FROM placed p JOIN lower_tree d ON d.tree = p.tree AND d.level = 0 AND d.place = p.place JOIN subroot s ON s.tree = p.tree
), fold AS (
  SELECT tree, row, 0 AS level, CASE WHEN levels = 0 THEN place_of_tree ELSE row END AS place, place_of_tree, levels,
         tampered AS digest, [] ::VARCHAR[] AS proof FROM start
  UNION ALL
  SELECT f.tree, f.row, f.level + 1,
         CASE WHEN f.level + 1 = any_value(f.levels) THEN any_value(f.place_of_tree) ELSE any_value(f.place) // 3 END,
         any_value(f.place_of_tree), any_value(f.levels),
         sha256(string_agg(CASE WHEN n.place = f.place THEN f.digest ELSE n.digest END, '' ORDER BY n.place)),
         any_value(f.proof) || coalesce(list(n.digest ORDER BY n.place) FILTER (n.place <> f.place), [])
  FROM fold f JOIN node n ON n.tree = f.tree AND n.level = f.level AND n.place // 3 = f.place // 3
  GROUP BY f.tree, f.row, f.level
), folded AS (
  SELECT tree, row, arg_max(digest, level) AS folded_root, arg_max(proof, level) AS proof FROM fold GROUP BY tree, row
)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(array_to_string(proof, '')) AS proof_sha256,
       folded_root, folded_root = r.digest AS verified
FROM placed p JOIN folded f ON f.tree = p.tree AND f.row = p.place JOIN subroot s ON s.tree = p.tree,
     (SELECT digest FROM upper_tree WHERE n = 1) r
""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
                      F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.build_manifest(merkle.document_leaves(docs, tampered), "source", ["doc_id"], "leaf")
    folded = merkle.fold_replaced(manifest, "leaf", "changed", ["doc_id"])
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.piece_digests(packed)


#: The state that follows a turn of the user or the assistant, and its role, by state (from 1 here).
NEXT_SQL, ROLE_SQL = "[2, 2, 3, 2][s + 1]", "['user', 'user', 'assistant', 'user'][s + 1]"


def _best_sql(state: int, after: int, kept: str) -> str:
    """The cheapest edit of a row but for inserts before it; ``kept`` is the cost after keeping it, if it may be."""
    return f"least({repair.DELETE} + a[{state + 1}], CASE WHEN fault NOT IN ('b', 'd') THEN {repair.REROLE} + a[{after + 1}] + extra END, " \
           f"CASE WHEN fault NOT IN ('b', 'd') THEN ({kept}) + extra END)"


@query(f"""
WITH RECURSIVE damaged AS (
  SELECT coalesce('=' || conv_id, '-') AS conv, turn, CASE k WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations)
  WHERE k <> 0
), placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i,
         count(*) OVER (PARTITION BY conv) AS n FROM damaged
), flagged AS (
  SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(shown, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault,
         lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM placed
), back AS (
  SELECT conv, n AS i, {list(repair.END)}::BIGINT[] AS b, NULL::BIGINT[] AS a, '' AS initial, '' AS fault, '' AS role, '' AS text
  FROM (SELECT DISTINCT conv, n FROM placed)
  UNION ALL
  SELECT conv, i, [least(e[1], {repair.INSERT} + e[3], {2 * repair.INSERT} + e[4]), least(e[2], {repair.INSERT} + e[3], {2 * repair.INSERT} + e[4]),
                   least(e[3], {repair.INSERT} + e[4]), least(e[4], {repair.INSERT} + e[3])], a, initial, fault, role, text
  FROM (SELECT *, [{_best_sql(0, 2, "CASE initial WHEN 's' THEN a[2] WHEN 'u' THEN a[3] END")},
                   {_best_sql(1, 2, "CASE initial WHEN 'u' THEN a[3] END")},
                   {_best_sql(2, 3, "CASE initial WHEN 'a' THEN a[4] END")},
                   {_best_sql(3, 2, "CASE initial WHEN 'u' THEN a[3] END")}] AS e
        FROM (SELECT f.conv, f.i, f.initial, f.fault, f.role, f.text, back.b AS a,
                     CASE f.fault WHEN 't' THEN {repair.TRUNCATED} ELSE 0 END AS extra
              FROM back JOIN flagged f ON f.conv = back.conv AND f.i = back.i - 1))
), trace AS (
  SELECT conv, 0::BIGINT AS i, 0::BIGINT AS s, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv FROM placed)
  UNION ALL
  SELECT conv, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE {NEXT_SQL} END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'I' THEN lines || [{ROLE_SQL} || ':'] WHEN 'K' THEN lines || [role || ':' || text]
                   ELSE lines || [{ROLE_SQL} || ':' || text] END
  FROM (SELECT *, CASE WHEN a IS NULL THEN 'I' WHEN {repair.DELETE} + a[s + 1] = b[s + 1] THEN 'D'
                       WHEN {repair.INSERT} + b[{NEXT_SQL} + 1] = b[s + 1] THEN 'I'
                       WHEN fault NOT IN ('b', 'd') AND kept IS NOT NULL
                            AND a[kept + 1] + CASE fault WHEN 't' THEN {repair.TRUNCATED} ELSE 0 END = b[s + 1] THEN 'K' ELSE 'R' END AS edit
        FROM (SELECT t.*, k.a, k.b, k.fault, k.role, k.text,
                     CASE WHEN t.s = 0 AND k.initial = 's' THEN 1 WHEN t.s IN (0, 1, 3) AND k.initial = 'u' THEN 2
                          WHEN t.s = 2 AND k.initial = 'a' THEN 3 END AS kept
              FROM trace t JOIN back k ON k.conv = t.conv AND k.i = t.i WHERE k.a IS NOT NULL OR t.s IN (1, 2)))
), done AS (
  SELECT conv, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM trace GROUP BY conv
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '-') AS conv FROM conversations)
     LEFT JOIN counted USING (conv) LEFT JOIN done USING (conv) LEFT JOIN (SELECT conv, b FROM back WHERE i = 0) USING (conv)
""")
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(table(spark, sf_dir, "conversations"))
