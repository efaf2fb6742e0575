"""Benchmark passages in training texts, found with a distributed positional inverted index.

The index holds postings (term, document, position) of the training texts for the terms that are
needed. Every window of ``WINDOW`` benchmark words is looked up from its rarest terms: their lists,
each shifted by the term's place in the item, are intersected by counting how many of them meet at
the same (document, item, shift). Only what all of them agree on is compared with the text, word by
word. Common terms never get a list. All steps are joins and aggregates over DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.llm.common import ascii_lower, id_and_text

WINDOW = 10
#: Lists that are intersected for each window.
RAREST = 3
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_IN_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many rows of terms or keys are sent to all executors; beyond, both sides are shuffled.
SENT_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, with A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")


def sendable(small: DataFrame) -> DataFrame:
    """Mark a table as broadcast if it has few rows; ``small`` is a written table, so counting is cheap."""
    return F.broadcast(small) if small.count() <= SENT_ROWS else small


def same(a: DataFrame, b: DataFrame) -> Column:
    """A document is its id and its text, so repeated ids and null ids stay apart."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return id_and_text(docs, id_column, text_column).withColumn("row", F.xxhash64("text"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``item, first, length``: windows of ``size`` words; an item with fewer is one window."""
    lengths = items.select("item", F.size("item_words").alias("n"))
    return lengths.select("item", F.least("n", F.lit(size)).alias("length"),
                          F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))).alias("first"))


def anchors(docs: DataFrame, items: DataFrame, size: int, rarest: int) -> DataFrame:
    """``item, first, length, at, term``: the rarest terms of each window by their count in the
    training texts, ties to the earlier place."""
    placed = cut(items.select("item", F.posexplode("item_words").alias("at", "term")))
    terms = cut(placed.select("term").distinct())
    counts = (docs.select(F.explode(words(F.col("text"))).alias("term")).join(sendable(terms), "term")
              .groupBy("term").agg(F.count("*").alias("count")))
    counted = placed.join(cut(counts), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    windows = item_windows(items, size)
    # A place belongs to the windows that begin at it or up to ``size - 1`` places before it.
    spread = counted.withColumn("first", F.explode(F.sequence(F.greatest(F.col("at") - size + 1, F.lit(0)), "at")))
    rank = Window.partitionBy("item", "first").orderBy("count", "at")
    return (windows.join(spread, ["item", "first"]).withColumn("place", F.row_number().over(rank))
            .filter(F.col("place") <= rarest).select("item", "first", "length", "at", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, row, pos``: the positions of the given terms in every text."""
    return (docs.select("doc_id", "row", F.posexplode(words(F.col("text"))).alias("pos", "term"))
            .join(sendable(terms), "term"))


def benchmark_items(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    items = benchmark.select(benchmark[item_column].alias("item_id"),
                             words(F.coalesce(benchmark[text_column], F.lit(""))).alias("item_words"))
    return (items.filter(F.col("item_id").isNotNull() & (F.size("item_words") > 0)).distinct()
            .withColumn("item", F.struct("item_id", F.xxhash64("item_words").alias("text"))))


def phrase_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Exact occurrences of item windows: ``doc_id, row, item_id, length, starts`` with a row per
    document, item and shift; ``starts`` are the word positions at which windows of it occur."""
    items = cut(benchmark_items(benchmark))
    chosen = cut(anchors(docs, items, size, rarest))
    places = cut(chosen.select("item", "length", "at", "term").distinct())
    index = postings(docs, cut(places.select("term").distinct()))
    agreed = (index.join(sendable(places), "term")
              .groupBy("doc_id", "row", "item", "length", (F.col("pos") - F.col("at")).alias("shift"))
              .agg(F.count("*").alias("met")).filter(F.col("met") >= F.least(F.lit(rarest), F.col("length"))))
    found = cut(agreed.select("doc_id", "row", "item", "length", "shift"))
    keys = cut(found.select("doc_id", "row").distinct())
    keys = sendable(keys)
    texts = docs.join(keys, same(docs, keys), "left_semi").withColumn("doc_words", words(F.col("text"))).drop("text")
    texts = texts.distinct()
    located = found.join(items.select("item", "item_words"), "item")
    both = located.join(texts, same(located, texts)).drop(texts["doc_id"]).drop(texts["row"])
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item_words"), F.size("doc_words") - F.col("shift")) - F.col("length")
    firsts = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(firsts, lambda w: F.slice("doc_words", F.col("shift") + w + 1, F.col("length"))
                      == F.slice("item_words", w + 1, F.col("length")))
    return (both.select("doc_id", "row", F.col("item.item_id").alias("item_id"), "length", "shift", starts.alias("hit"))
            .filter(F.size("hit") > 0)
            .select("doc_id", "row", "item_id", "length",
                    F.transform("hit", lambda w: w + F.col("shift")).alias("starts")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Which documents hold benchmark passages:
    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row per row of ``docs``.

    A document word is hit if an occurrence of an item window covers it. A null or empty text has no
    words and no hits; an empty benchmark hits nothing; items without an id or without words are left
    out. Repeated documents get equal results. Ids are of any type. Other columns are not read.
    """
    texts = keyed(docs, id_column, text_column)
    hits = phrase_hits(texts, benchmark, size, rarest)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1)))
    per_doc = (hits.select("doc_id", "row", "item_id", F.array_distinct(covered).alias("covered"))
               .groupBy("doc_id", "row")
               .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
                    F.collect_set(F.col("item_id").cast("string")).alias("items")))
    per_doc = cut(per_doc)
    counted = texts.select("doc_id", "row", F.regexp_count("text", F.lit(WORD_IN_ANY_CASE)).cast("long").alias("n_words"))
    per_doc = sendable(per_doc)
    names = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (counted.join(per_doc, same(counted, per_doc), "left")
            .select(counted["doc_id"], "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item window occurs."""
    hits = phrase_hits(keyed(docs, id_column, text_column), benchmark, size, rarest)
    hit = sendable(cut(hits.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()))
    own = F.xxhash64(F.coalesce(docs[text_column], F.lit("")))
    return docs.join(hit, docs[id_column].eqNullSafe(hit["_id"]) & (own == hit["_row"]), "left_anti")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 20, size: int = WINDOW,
                      rarest: int = RAREST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Item windows whose rarest terms lie together in a document, in any order, within ``slop``
    consecutive words: ``doc_id, item_id, first, pos`` (the first such stretch of the document).

    Positions are dealt to overlapping stretches of ``2 * slop`` words, so a group stays small however
    often a term occurs in a document. Nulls and empty tables as for ``contamination``.
    """
    texts = keyed(docs, id_column, text_column)
    chosen = cut(anchors(texts, cut(benchmark_items(benchmark)), size, rarest))
    need = chosen.groupBy("item", "first").agg(F.countDistinct("term").alias("need"))
    chosen = cut(chosen.select("item", "first", "term").distinct().join(need, ["item", "first"]))
    index = postings(texts, cut(chosen.select("term").distinct()))
    stretch = F.floor(F.col("pos") / slop)
    placed = (index.join(sendable(chosen), "term").distinct()
              .withColumn("stretch", F.explode(F.array(stretch, stretch - 1))))
    groups = (placed.groupBy("doc_id", "row", "item", "first", "need", "stretch")
              .agg(F.collect_list(F.struct("pos", "term")).alias("met")))
    begins = F.filter(F.transform("met", lambda m: m["pos"]), lambda p: F.size(F.array_distinct(F.transform(
        F.filter("met", lambda m: (m["pos"] >= p) & (m["pos"] < p + slop)), lambda m: m["term"]))) >= F.col("need"))
    return (groups.withColumn("pos", F.array_min(begins)).filter("pos IS NOT NULL")
            .groupBy("doc_id", "row", F.col("item.item_id").alias("item_id"), "first").agg(F.min("pos").alias("pos"))
            .select("doc_id", "item_id", "first", "pos"))
