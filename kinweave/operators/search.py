"""Full-text and vector search for many queries in one job."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from kinweave.functions.rules import look_up
from kinweave.functions.text import count_tokens, query_tokens
from kinweave.lineage import cut
from kinweave.operators.ranking import cap_per_group, with_position

# --- fixed values: field weights and BM25 constants ----------------------------------------------
FIELD_WEIGHTS: dict[str, float] = {
    "name": 2.0, "aliases": 1.5, "prototype": 1.0, "description": 0.5,
    "mythology": 1.2, "name_py": 1.2, "aliases_py": 1.0,
}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LEXICAL_SHARE, SEMANTIC_SHARE = 0.6, 0.4
FALLBACK_SCORE = 10.0

#: Queries and vectors of a block, and rows of a matrix product at a time.
QUERY_BLOCK, SHARD, PRODUCT_ROWS = 2048, 16_384, 128
#: Postings of a shard of documents, tokens that meet them at a time, and counted terms of a batch.
SHARD_POSTINGS, TOKEN_BLOCK, BATCH_TERMS = 1_000_000, 100_000, 100_000
# Scores are rounded so that the order in which parts are summed up never settles a tie.
DIGITS = 9


def transliterate(texts: DataFrame, mapping: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Spell CJK characters out by ``mapping`` (char, spelling): id, spelled. Other runs stay whole."""
    units = texts.select(id_col, F.posexplode(
        F.regexp_extract_all(text_col, F.lit("([一-鿿]|[^一-鿿]+)"))).alias("pos", "char"))
    spelled = units.join(mapping, "char", "left").withColumn("spelling", F.coalesce("spelling", "char"))
    return spelled.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "spelling"))).alias("s")).select(
        id_col, F.array_join("s.spelling", " ").alias("spelled"))


def field_texts(vertices: DataFrame, aliases: DataFrame, mapping: DataFrame | None = None,
                description_chars: int | None = None) -> DataFrame:
    """Indexed texts of each entity, one row per text: doc_id, field, text.

    Aliases are a row each, so an entity may have any number. ``mapping`` adds the spelled-out names;
    ``description_chars`` cuts descriptions.
    """
    description = F.col("description") if description_chars is None else F.substring("description", 1, description_chars)
    fields = F.explode(F.array(*[
        F.struct(F.lit(field).alias("field"), F.coalesce(text, F.lit("")).alias("text"))
        for field, text in (("name", F.col("name")), ("prototype", F.col("prototype")), ("description", description),
                            ("mythology", F.col("mythology")))]))
    own = vertices.select(F.col("id").alias("doc_id"), fields.alias("f")).select("doc_id", "f.field", "f.text")
    others = aliases.select(F.col("id").alias("doc_id"), F.lit("aliases").alias("field"), F.col("alias").alias("text"))
    texts = own.unionByName(others)
    if mapping is not None:
        named = texts.filter(F.col("field").isin("name", "aliases"))
        marked = named.withColumn("id", F.struct("doc_id", "field", "text"))
        spelled = transliterate(marked.select("id", "text").distinct(), mapping).select(
            "id.doc_id", F.concat("id.field", F.lit("_py")).alias("field"), F.col("spelled").alias("text"))
        texts = texts.unionByName(spelled)
    return texts.filter(F.col("text") != "")


def build_postings(texts: DataFrame) -> DataFrame:
    """Inverted index of (doc_id, field, text): term, field, doc_id, tf.

    Texts are dealt out by document before they are taken apart. So they are shuffled, not their
    terms, and no task has to count the terms of all that a scan gives it, which may be a whole table.
    The texts of a document then stand next to each other, so one document is counted at a time.
    """
    dealt = texts.select("doc_id", "field", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    terms = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())]))
    counted = dealt.mapInArrow(_counted, StructType([texts.schema["doc_id"], texts.schema["field"], StructField("terms", terms)]))
    return counted.select("doc_id", "field", F.explode("terms").alias("t")).select("t.term", "field", "doc_id", "t.tf")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and field with the terms there and how often they occur."""
    rows: list[tuple] = []
    ends, terms, times = [0], [], []
    types: list[pa.DataType] = []

    def made() -> pa.RecordBatch:
        ids, fields = (pa.array(values, kind) for values, kind in zip(zip(*rows), types))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["term", "tf"]))
        return pa.RecordBatch.from_arrays([ids, fields, listed], ["doc_id", "field", "terms"])

    def in_order() -> Iterator[tuple]:
        for batch in batches:
            types[:] = [batch.schema.field(c).type for c in ("doc_id", "field")]
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "field", "text")))

    for doc, texts in groupby(in_order(), key=lambda row: row[0]):
        counts: dict[str, Counter[str]] = {}
        for _, field, text in texts:
            found = count_tokens(text)
            if field in counts:
                counts[field].update(found)
            else:
                counts[field] = found
        for field, found in counts.items():
            rows.append((doc, field))
            terms += found.keys()
            times += found.values()
            ends.append(len(terms))
        if len(terms) >= BATCH_TERMS:
            yield made()
            rows, ends, terms, times = [], [0], [], []
    if rows:
        yield made()


def document_lengths(postings: DataFrame) -> DataFrame:
    """Tokens per document: doc_id, length."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("length"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    per_doc = postings.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


def bm25_search(queries: DataFrame, postings: DataFrame, limit: int = 20,
                weights: Mapping[str, float] | None = None, tokens: int | None = None) -> DataFrame:
    """Best documents per query: query_id, doc_id, score; higher is better.

    Query tokens are prefixes, joined by OR; the score is BM25 over the weighted sum of the fields.
    Equal texts are searched once. Documents lie in shards of some ``SHARD_POSTINGS`` postings, tokens and
    texts in blocks. Tokens first meet the terms of a shard, which leaves one row per document: its length
    and how often it has which token. Once it is known how many documents have a token, texts meet these
    rows, and only the best ``limit`` of a text in a shard go on. ``postings`` is read twice and had better
    be a written table. With ``tokens``, only so many tokens of each text are searched; the reference takes 12.
    """
    texts = cut(queries.select("text").distinct().withColumn("text_no", F.monotonically_increasing_id()))
    asked = texts.select("text_no", F.explode(query_tokens(F.col("text"), tokens)).alias("token"))
    asked = cut(asked.groupBy("text_no", "token").agg(F.count(F.lit(1)).alias("times")))
    known = cut(asked.select("token").distinct().withColumn("token_no", F.monotonically_increasing_id()))
    shards = max(1, -(-postings.count() // SHARD_POSTINGS))
    documents = _documents_with_tokens(known, postings, dict(weights or FIELD_WEIGHTS), shards)
    corpus = documents.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean")).select(
        F.struct("docs", "mean").alias("c")).scalar()
    found = documents.select(F.explode("tokens").alias("token_no")).groupBy("token_no").agg(F.count(F.lit(1)).alias("n"))
    odds = F.log((corpus["docs"] - F.col("n") + 0.5) / (F.col("n") + 0.5))
    gains = asked.join(known.join(found, "token_no"), "token").select(
        "text_no", "token_no", (F.when(odds > 0, odds).otherwise(LEAST_IDF) * F.col("times") * (K1 + 1)).alias("gain"))
    base = K1 * (1 - B + B * F.col("length") / corpus["mean"])
    ranked = _best_documents(gains, documents.select("doc_id", base.alias("base"), "tokens", "found"), texts.count(), shards, limit)
    return queries.select("query_id", "text").join(ranked.join(texts, "text_no"), "text").select("query_id", "doc_id", "score")


def _number(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")


def _every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


# A pair of a shard and a block is one number, ``shard * blocks + block``: Spark sorts by one faster than by two.
def _in_every_block(name: str, shards: int, blocks: int) -> Column:
    """Cells of one shard, that of ``name``."""
    first = _number(name, shards) * blocks
    return (first if blocks == 1 else F.explode(F.sequence(first, first + (blocks - 1)))).alias("cell")


def _in_every_shard(name: str, shards: int, blocks: int) -> Column:
    """Cells of one block, that of ``name``."""
    first = _number(name, blocks)
    return F.explode(F.sequence(first, first + (shards - 1) * blocks, F.lit(blocks))).alias("cell")


def _documents_with_tokens(known: DataFrame, postings: DataFrame, weights: dict[str, float], shards: int) -> DataFrame:
    """Of each document its length, the numbers of its tokens and the weighted sum of what begins with them.

    ``known`` is (token, token_no). With more than a block of tokens, a document has a row for each block
    first, and these are put together.
    """
    blocks = max(1, -(-known.count() // TOKEN_BLOCK))
    weight = F.coalesce(look_up(weights, F.col("field")), F.lit(1.0)) * F.col("tf")
    left = postings.select("term", "doc_id", weight.cast("double").alias("weight"), F.col("tf").cast("long").alias("tf"),
                           _in_every_block("doc_id", shards, blocks))
    right = known.select("token", "token_no", _in_every_shard("token", shards, blocks))
    schema = StructType([postings.schema["doc_id"], StructField("length", LongType()), StructField("tokens", ArrayType(LongType())),
                         StructField("found", ArrayType(DoubleType()))])
    rows = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_tokens_of_documents, schema)
    if blocks == 1:
        return cut(rows)
    return cut(cut(rows).groupBy("doc_id").agg(F.first("length").alias("length"), *[
        F.flatten(F.array_sort(F.collect_list(F.struct("tokens", "found"))).getField(c)).alias(c) for c in ("tokens", "found")]))


def _tokens_of_documents(postings: pa.Table, known: pa.Table) -> pa.Table:
    """Tokens of one block in the documents of one shard."""
    documents, terms = (postings[c].combine_chunks().dictionary_encode() for c in ("doc_id", "term"))
    ids, doc, size = documents.dictionary, documents.indices.to_numpy(), len(documents.dictionary)
    words = terms.dictionary.to_pylist()
    places = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in places]
    rank = np.empty(len(words), np.int64)
    rank[places] = np.arange(len(words))
    of_row = rank[terms.indices.to_numpy()]
    order = np.argsort(of_row, kind="stable")
    starts = np.searchsorted(of_row[order], np.arange(len(words) + 1))
    doc_by_term, weight_by_term = doc[order], postings["weight"].to_numpy()[order]
    docs, numbers, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for token, number in zip(known["token"].to_pylist(), known["token_no"].to_pylist()):
        # The terms that begin with a token stand next to each other.
        low = bisect_left(words, token)
        high = bisect_right(words, token, low, key=lambda word: word[:len(token)])
        if low < high:
            rows = slice(starts[low], starts[high])
            having, at = np.unique(doc_by_term[rows], return_inverse=True)
            docs.append(having)
            numbers.append(np.full(len(having), number))
            sums.append(np.bincount(at, weight_by_term[rows]))
    holder = np.concatenate(docs)
    order = np.argsort(holder, kind="stable")
    ends = pa.array(np.searchsorted(holder[order], np.arange(size + 1)), pa.int32())
    length = np.bincount(doc, postings["tf"].to_numpy(), size).astype(np.int64)
    return pa.table({"doc_id": ids, "length": length,
                     **{name: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)[order]))
                        for name, parts in (("tokens", numbers), ("found", sums))}})


def _best_documents(gains: DataFrame, documents: DataFrame, texts: int, shards: int, limit: int) -> DataFrame:
    """Best documents per text: text_no, doc_id, score. ``gains`` is what a token adds at most, by text."""
    blocks = max(1, -(-texts // QUERY_BLOCK))
    left = gains.select("*", _in_every_shard("text_no", shards, blocks))
    right = documents.select("*", _in_every_block("doc_id", shards, blocks))
    schema = StructType([gains.schema["text_no"], documents.schema["doc_id"], StructField("score", DoubleType())])
    scores = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_best_of_shard(limit), schema)
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    return cap_per_group(rounded, ["text_no"], [F.desc("score"), "doc_id"], limit)


def _best_of_shard(limit: int):
    """Best documents of one shard for one block of texts."""
    def best(gains: pa.Table, documents: pa.Table) -> pa.Table:
        documents = documents.sort_by("doc_id")
        tokens, found = (documents[c].combine_chunks() for c in ("tokens", "found"))
        of_row = np.repeat(np.arange(len(documents)), np.diff(tokens.offsets.to_numpy()))
        sums = found.flatten().to_numpy()
        parts = sums / (sums + documents["base"].to_numpy()[of_row])
        token = tokens.flatten().to_numpy()
        by_token = np.argsort(token, kind="stable")
        token, of_row, parts = token[by_token], of_row[by_token], parts[by_token]
        gains = gains.sort_by([("text_no", "ascending"), ("token_no", "ascending")])
        text, asked, gain = (gains[c].to_numpy() for c in ("text_no", "token_no", "gain"))
        lows, highs = np.searchsorted(token, asked), np.searchsorted(token, asked, "right")
        out: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else [0]
        for first, end in zip(edges[:-1], edges[1:]):
            scores = np.zeros(len(documents))
            for low, high, much in zip(lows[first:end], highs[first:end], gain[first:end]):
                scores[of_row[low:high]] += parts[low:high] * much
            rows = _leading(scores, limit)
            for column, values in zip(out, (np.full(len(rows), text[first]), rows, scores[rows])):
                column.append(values)
        numbers, rows, scores = map(np.concatenate, out)
        return pa.table({"text_no": numbers, "doc_id": documents["doc_id"].combine_chunks().take(pa.array(rows)), "score": scores})

    return best


def _leading(scores: np.ndarray, limit: int) -> np.ndarray:
    """Rows that can be among the best ``limit`` after rounding. Of the very same score, the first ``limit`` can."""
    rows = np.flatnonzero(scores)
    if len(rows) > limit:
        rows = rows[scores[rows] >= np.partition(scores[rows], -limit)[-limit] - 2 * 10.0**-DIGITS]
        order = np.argsort(scores[rows], kind="stable")
        same = scores[rows][order]
        rows = rows[order[np.arange(len(same)) - np.searchsorted(same, same) < limit]]
    return rows


def contained_needles(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Which needles occur in which texts: text_id, needle, without comparing every pair.

    All pieces of the texts that are as long as some needle are joined on equality.
    """
    lengths = needles.agg(F.array_sort(F.collect_set(F.length("needle"))).alias("l")).scalar()
    sized = texts.select("text_id", "text", F.explode(lengths).alias("n")).filter(F.col("n") <= F.length("text"))
    pieces = sized.select("text_id", F.transform(
        F.sequence(F.lit(1), F.length("text") - F.col("n") + 1),
        lambda at: F.substring(F.col("text"), at, F.col("n"))).alias("p"))
    pieces = pieces.select("text_id", F.explode(F.array_distinct("p")).alias("needle"))
    return pieces.join(needles.select("needle").distinct(), "needle").select("text_id", "needle")


def fallback_search(queries: DataFrame, found: DataFrame, texts: DataFrame, limit: int = 20) -> DataFrame:
    """For queries without a hit, documents whose name or alias contains the query text, constant score."""
    missed = queries.join(found.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lower(F.trim("text")).alias("needle")).filter(F.col("needle") != "")
    named = texts.filter(F.col("field").isin("name", "aliases", "name_py")).select(
        F.struct("doc_id", "text").alias("text_id"), F.lower("text").alias("text"))
    pairs = contained_needles(named, missed).select("text_id.doc_id", "needle").distinct()
    # Every query of one text takes the same first documents.
    pairs = cap_per_group(pairs, ["needle"], ["doc_id"], limit)
    hits = missed.join(pairs, "needle").select("query_id", "doc_id", F.lit(FALLBACK_SCORE).alias("score"))
    return cap_per_group(hits, ["query_id"], ["doc_id"], limit)


def lexical_search(queries: DataFrame, postings: DataFrame, texts: DataFrame, limit: int = 20,
                   weights: Mapping[str, float] | None = None, tokens: int | None = None) -> DataFrame:
    """``bm25_search``; a query that finds nothing takes the names and aliases that contain its text."""
    found = cut(bm25_search(queries, postings, limit, weights, tokens))
    return found.unionByName(fallback_search(queries, found, texts, limit))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest vectors of each query (query_id, vector): query_id, id, score.

    Queries lie in blocks and vectors in shards of bounded size. Each block meets each shard in a task of
    its own, as one matrix product, and only the best ``k`` of a query there go on. So neither side
    passes through the driver, and the plan is the same for any number of queries. A zero vector scores
    0; null vectors take no part. Equal scores go to the smaller id.
    """
    asked, stored = (df.filter(F.col("vector").isNotNull()) for df in (queries, vectors))
    blocks, shards = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (stored, SHARD)))

    left = asked.select("query_id", "vector", _number("query_id", blocks).alias("block"), _every(shards).alias("shard"))
    right = stored.select("id", "vector", _number("id", shards).alias("shard"), _every(blocks).alias("block"))
    types = {"query_id": queries.schema["query_id"].dataType, "id": vectors.schema["id"].dataType}
    schema = StructType([*(StructField(n, t) for n, t in types.items()), StructField("score", DoubleType())])
    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_nearest(k), schema)
    rounded = near.withColumn("score", F.round("score", DIGITS))
    return cap_per_group(rounded, ["query_id"], [F.desc("score"), "id"], k)


def _nearest(k: int):
    """Best vectors of one shard for one block of queries, some queries at a time."""
    def nearest(asked: pa.Table, stored: pa.Table) -> pa.Table:
        names, ids = asked["query_id"].combine_chunks(), stored["id"].combine_chunks()
        queries, scores = [np.empty(0, np.int64)], [np.empty(0)]
        hits = [np.empty(0, np.int64)]
        if len(names) and len(ids):
            matrix, others = _unit_rows(_matrix(asked["vector"])), _unit_rows(_matrix(stored["vector"])).T
            for start in range(0, len(names), PRODUCT_ROWS):
                found = matrix[start:start + PRODUCT_ROWS] @ others
                # Everything as good as the k-th stays, so ties are settled by id over all shards.
                least = np.partition(found, -k, 1)[:, -k, None] - 10.0**-DIGITS if found.shape[1] > k else -np.inf
                row, column = np.nonzero(found >= least)
                queries.append(row + start)
                hits.append(column)
                scores.append(found[row, column])
        return pa.table({"query_id": names.take(pa.array(np.concatenate(queries))), "id": ids.take(pa.array(np.concatenate(hits))),
                         "score": np.concatenate(scores)})

    return nearest


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return matrix / norms


def hybrid_search(lexical: DataFrame, semantic: DataFrame, n: int = 10) -> DataFrame:
    """Merge both result lists per query: 0.6 of the share of the best lexical score, 0.4 of the cosine.

    The lists are search results, so a query has a bounded number of rows.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    share = F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0))
    left = lexical.select("query_id", "doc_id", share.alias("lex"))
    right = semantic.select("query_id", F.col("id").alias("doc_id"), F.greatest("score", F.lit(0.0)).alias("sem"))
    zero = F.lit(0.0)
    merged = left.join(right, ["query_id", "doc_id"], "full").select(
        "query_id", "doc_id",
        F.round(LEXICAL_SHARE * F.coalesce("lex", zero) + SEMANTIC_SHARE * F.coalesce("sem", zero), DIGITS).alias("score"))
    return cap_per_group(merged, ["query_id"], [F.desc("score"), "doc_id"], n)


def embedding_worklist(vertices: DataFrame, embeddings: DataFrame, model: str, batch: int = 32,
                       description_chars: int = 200) -> DataFrame:
    """Entities without a vector of this model, with the text to embed, in numbered batches."""
    done = embeddings.filter(F.col("model") == model).select(F.col("character_id").alias("id"))
    blank = F.lit("")
    text = F.concat_ws("｜", "name", F.coalesce("mythology", blank), F.coalesce("prototype", blank),
                       F.substring(F.coalesce("description", blank), 1, description_chars))
    todo = vertices.join(done, "id", "left_anti").select("id", text.alias("text"))
    return with_position(todo, ["id"]).select("id", "text", F.floor(F.col("position") / batch).alias("batch_no"))
