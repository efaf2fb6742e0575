"""Nearest vectors by inner product with a permutation index.

A vector is represented by its pivots in the order of nearness, cut after ``RANKS``. It is posted, as
that list alone, in the inverted files of its first ``POSTS`` pivots. A query reads the files of its
first ``PROBES`` pivots and ranks what it finds there by footrule distance between the two lists; a pair
that shares several files is ranked in the first of the query's only. The best part of the ranking goes
on to be reranked: only then vectors are fetched, shard by shard, and multiplied pair by pair.

Nearness: for the index, vectors get one more component that brings all to the same length, and
queries a zero, so that the nearest by distance are those with the largest inner product.

Pivots come from a sample of ``SAMPLE`` vectors, and so does the part of the ranking that goes on: the
one that holds ``COVER`` of the sample's own nearest neighbours, which lie farther down than those among
all vectors. Each query turns it into a distance by its own ranking of the sample. There is no cap on
candidates. A query for which the files hold too few is searched again in all files, to the end.

Keys are dense, so files and shards are cut into stretches of keys, for vectors and for queries: neither
a popular pivot nor the number of queries makes a task large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.llm.common import batch, small_batches
from kinweave.llm.places import with_places

PIVOTS, POSTS, PROBES, RANKS = 256, 8, 32, 120
SAMPLE, SAMPLE_QUERIES, COVER = 4096, 400, 0.95
#: Keys of vectors and of queries in one block of a file.
BLOCK, ASK_BLOCK = 1 << 18, 1 << 19
#: Keys of vectors and of queries in one block of the reranking; a pair of places in them is 32 bits.
SHARD_BITS, ASK_SHARD_BITS = 14, 18
#: Pairs in a row of candidates, and those that are reranked at once.
ROW_PAIRS, PAIRS_AT_ONCE = 1 << 14, 1 << 19
FARTHEST = 2 ** 31 - 1


@dataclass
class Index:
    """Pivots (of unit length in the longer space), the length all vectors are brought to, where the
    sample has its pivots, and the part of a ranking that is reranked."""

    pivots: np.ndarray
    length: float
    sample: np.ndarray
    part: float

    def order(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """The nearest pivots of each vector, at most ``RANKS``, as pivot numbers."""
        extra = np.zeros(len(vectors))
        if not queries:
            extra = np.sqrt(np.maximum(self.length ** 2 - (vectors * vectors).sum(1), 0))
        near = vectors @ self.pivots[:, :-1].T + extra[:, None] * self.pivots[None, :, -1]
        return np.argsort(-near, axis=1, kind="stable")[:, :RANKS].astype(np.uint8)

    def reach(self, order: np.ndarray) -> int:
        """The footrule distance within which a query finds its part of the sample."""
        if self.part >= 1:
            return FARTHEST
        apart = footrules(order, self.sample)
        last = int(self.part * len(apart))
        return int(np.partition(apart, last)[last])


def places(orders: np.ndarray, pivots: int) -> np.ndarray:
    """For each pivot and vector, the pivot's place in the vector's list; its length if not there."""
    ranks = orders.shape[1]
    out = np.full((len(orders), pivots), ranks, np.int8)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(ranks, dtype=np.int8)[None, :].repeat(len(orders), 0), 1)
    return np.ascontiguousarray(out.T)


def footrules(order: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Footrule distance over a query's pivots to each vector."""
    apart = where[order] - np.arange(len(order), dtype=np.int8)[:, None]
    return np.abs(apart, out=apart).sum(0, dtype=np.int16)


def fit_index(vectors: np.ndarray, length: float, k: int) -> Index:
    """Pivots are the first vectors of the sample, of which there are few if the sample is small."""
    extra = np.sqrt(np.maximum(length ** 2 - (vectors * vectors).sum(1), 0))
    longer = np.column_stack([vectors, extra])
    pivots = longer[:max(1, min(PIVOTS, len(longer) // 16))] / length
    index = Index(pivots, length, np.zeros((0, 0), np.int8), 1.0)
    index.sample = places(index.order(vectors, False), len(pivots))
    first = max(0, len(vectors) - SAMPLE_QUERIES)
    if len(vectors) > 2 * k:
        down = []
        for own, order in enumerate(index.order(vectors[first:], True), first):
            products = vectors @ vectors[own]
            products[own] = -np.inf
            apart = footrules(order, index.sample)
            near = np.argsort(-products)[:k]
            down.append(np.searchsorted(np.sort(apart), apart[near], "right") / len(vectors))
        index.part = float(np.quantile(np.concatenate(down), COVER))
    return index


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vec`` of the rows that take part: with an id, and a vector of finite numbers, not all zero."""
    vec = F.col("vec")
    return (table.select(table[id_column].cast("long").alias("vec_id"), table[vector_column].cast("array<double>").alias("vec"))
            .filter(F.col("vec_id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0))
            .filter(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
            .filter(F.exists(vec, lambda v: v != 0)))


def search(table: DataFrame, is_query: F.Column, k: int = 20, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to each query row: ``query_id, rank, vec_id, score``.

    ``is_query`` is over ``vec_id``. The row itself is no candidate; ties go to the smaller id. Rows
    whose id or vector is null, or whose vector is empty, all zero or holds a null or non-finite
    component take no part; nor do vectors with another number of components than most. Equal vectors
    are searched once; of a group, the ``k + 1`` smallest ids are all that any query can need. Repeated
    ids count as rows of their own: a query id with several vectors has a list for each of them, and no
    row under its own id is in it. An empty table gives an empty result.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = usable(table, id_column, vector_column)
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    shape = (rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("most"))
             .orderBy(F.desc("n"), "size").first())
    size, length = (shape["size"], float(np.sqrt(shape["most"]))) if shape else (1, 1.0)
    rows = rows.filter(F.size("vec") == size).withColumns(
        {"one": F.xxhash64("vec"), "two": F.xxhash64(F.lit(1), "vec")})
    first = F.row_number().over(Window.partitionBy("one", "two").orderBy("vec_id"))
    groups = rows.withColumn("place", first).filter(F.col("place") <= k + 1).groupBy("one", "two").agg(
        F.min("vec_id").alias("least"), F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    # Keys are in the order of the smallest ids, which settles ties, and unlike those never repeat.
    groups = cut(with_places(groups.withColumn("all", F.lit("")), "all", ["least", "one", "two"])
                 .withColumnRenamed("place", "key").drop("all", "least"))
    asked = rows.filter(is_query).select("vec_id", "one", "two").distinct()
    asked = cut(asked.join(groups.select("one", "two", "key"), ["one", "two"])
                .select(F.col("vec_id").alias("query_id"), "key"))
    sample = groups.orderBy("one", "two").limit(SAMPLE).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(np.array([r["vec"] for r in sample]), length, k)
    wanted = groups.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vec")
    n_keys = groups.count()
    found = cut(nearest(groups, wanted, index, k, n_keys))
    sizes = groups.select(F.col("key").alias("hit"), F.size("members").alias("m"))
    held = found.join(sizes, "hit").groupBy("key").agg(F.sum("m").alias("m")).filter(F.col("m") > k)
    short = cut(wanted.join(held, "key", "left_anti"))
    if not short.isEmpty():
        found = (found.join(short.select("key"), "key", "left_anti")
                 .unionByName(nearest(groups, short, index, k, n_keys, whole=True)))
    members = found.join(groups.select(F.col("key").alias("hit"), F.explode("members").alias("vec_id")), "hit")
    of_key = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = members.withColumn("place", F.row_number().over(of_key)).filter(F.col("place") <= k + 1)
    of_query = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (asked.join(best.select("key", "vec_id", "score"), "key").filter("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def posted(vectors: DataFrame, index: Index, queries: bool, lists: int, whole: bool = False) -> DataFrame:
    """``key, reach, list, file``: a row for each of the first ``lists`` pivots; ``list`` are the nearest
    pivots. Vectors themselves stay behind. With ``whole``, a query reads all files to the end."""
    schema = "key long, reach int, list binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                found = index.order(matrix(rows["vec"]), queries)
                reach = [index.reach(o) if queries and not whole else FARTHEST for o in found]
                yield batch(schema, key=rows["key"], reach=reach, list=[x.tobytes() for x in found])

    files = F.array(*(F.conv(F.hex(F.substring("list", i + 1, 1)), 16, 10).cast("int")
                      for i in range(min(lists, len(index.pivots), RANKS))))
    if whole:
        files = F.sequence(F.lit(0), F.lit(len(index.pivots) - 1))
    return vectors.select("key", "vec").mapInArrow(work, schema).withColumn("file", F.explode(files))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks_of(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Runs of rows with the same first ``names`` columns, each as batches, without holding a run."""
    def parts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for rows in batches:
            if rows.num_rows:
                values = np.stack([rows.column(i).to_numpy() for i in range(names)], axis=1)
                bounds = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1), len(values)]
                for a, b in zip(bounds, bounds[1:]):
                    yield tuple(values[a].tolist()), rows.slice(a, b - a)

    found = parts()
    following = next(found, None)

    def run(name: tuple) -> Iterator[pa.RecordBatch]:
        nonlocal following
        while following is not None and following[0] == name:
            yield following[1]
            following = next(found, None)

    while following is not None:
        name = following[0]
        rows = run(name)
        yield name, rows
        for _ in rows:  # what the caller has left unread
            pass


def nearest(groups: DataFrame, wanted: DataFrame, index: Index, k: int, n_keys: int, whole: bool = False) -> DataFrame:
    """``key, hit, score``: for each wanted key, its ``k + 1`` best among the groups that it meets."""
    return rerank(groups, wanted, rank(groups, wanted, index, n_keys, whole), k, n_keys)


def stretches(n_keys: int, size: int) -> F.Column:
    return F.sequence(F.lit(0), F.lit(max(0, (n_keys - 1) // size)))


def rank(groups: DataFrame, wanted: DataFrame, index: Index, n_keys: int, whole: bool) -> DataFrame:
    """``ask_shard, shard, pairs``: what lies in each query's part of its ranking, as pairs of places."""
    files = (posted(groups, index, False, 1 if whole else POSTS).withColumn("block", F.floor(F.col("key") / BLOCK).cast("int"))
             .withColumn("ask_block", F.explode(stretches(n_keys, ASK_BLOCK))).withColumn("asks", F.lit(False)))
    asks = (posted(wanted, index, True, PROBES, whole).withColumn("ask_block", F.floor(F.col("key") / ASK_BLOCK).cast("int"))
            .withColumn("block", F.explode(stretches(n_keys, BLOCK))).withColumn("asks", F.lit(True)))
    names = ["file", "block", "ask_block", "asks", "key", "reach", "list"]
    # Asks come first in each block.
    together = (files.select(names).unionByName(asks.select(names)).repartition("file", "block", "ask_block")
                .sortWithinPartitions("file", "block", "ask_block", F.desc("asks"), "key"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in blocks_of(batches, 3):
            yield from rank_block(pa.Table.from_batches(list(rows)), name[0], len(index.pivots), whole)

    return together.mapInArrow(work, PAIRS)


PAIRS = "ask_shard int, shard int, pairs binary"


def rank_block(block: pa.Table, file: int, pivots: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rank one block of a file for one block of queries."""
    n = int(np.count_nonzero(block["asks"].to_numpy()))
    if n == 0 or n == len(block):
        return
    keys, reach = block["key"].to_numpy(), block["reach"].to_numpy()
    lists = np.frombuffer(b"".join(block["list"].to_pylist()), np.uint8).reshape(len(block), -1)
    where = places(lists[n:], pivots)
    in_file = where < POSTS
    hits = keys[n:]
    held: list[np.ndarray] = []
    size = 0
    for i in range(n):
        order = lists[i]
        take = footrules(order, where) <= reach[i] if reach[i] < FARTHEST else np.ones(len(hits), bool)
        if not whole:  # what shares an earlier file has been ranked there
            take &= ~in_file[order[:int(np.flatnonzero(order == file)[0])]].any(0)
        taken = hits[take]
        held.append(np.stack([np.full(len(taken), keys[i]), taken]))
        size += len(taken)
        if size >= PAIRS_AT_ONCE:
            yield from packed(np.concatenate(held, axis=1))
            held, size = [], 0
    yield from packed(np.concatenate(held, axis=1)) if held else ()


def packed(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of a query and a hit by shards of both, a pair in 32 bits."""
    ask_shard, shard = pairs[0] >> ASK_SHARD_BITS, pairs[1] >> SHARD_BITS
    codes = (((pairs[0] & ((1 << ASK_SHARD_BITS) - 1)) << SHARD_BITS) | (pairs[1] & ((1 << SHARD_BITS) - 1))).astype("<u4")
    order = np.lexsort([shard, ask_shard])
    ask_shard, shard, codes = ask_shard[order], shard[order], codes[order]
    new = np.flatnonzero((np.diff(ask_shard) != 0) | (np.diff(shard) != 0)) + 1
    bounds = [0, *new, len(codes)]
    starts = [(a, min(a + ROW_PAIRS, end)) for begin, end in zip(bounds, bounds[1:]) for a in range(begin, end, ROW_PAIRS)]
    if starts:
        yield batch(PAIRS, ask_shard=[ask_shard[a] for a, _ in starts], shard=[shard[a] for a, _ in starts],
                    pairs=[codes[a:b].tobytes() for a, b in starts])


def rerank(groups: DataFrame, wanted: DataFrame, candidates: DataFrame, k: int, n_keys: int) -> DataFrame:
    """``key, hit, score``: the ``k + 1`` candidates of each query with the largest products."""
    none = F.lit(None)
    shard, ask_shard = F.shiftright("key", SHARD_BITS).cast("int"), F.shiftright("key", ASK_SHARD_BITS).cast("int")
    vectors = groups.select("key", "vec", shard.alias("shard"), F.lit(0).alias("kind"), none.cast("binary").alias("pairs"),
                            F.explode(stretches(n_keys, 1 << ASK_SHARD_BITS)).alias("ask_shard"))
    asks = wanted.select("key", "vec", ask_shard.alias("ask_shard"), F.lit(1).alias("kind"), none.cast("binary").alias("pairs"),
                         F.explode(stretches(n_keys, 1 << SHARD_BITS)).alias("shard"))
    pairs = candidates.select(none.cast("long").alias("key"), none.cast("array<double>").alias("vec"), "shard",
                              F.lit(2).alias("kind"), "pairs", "ask_shard")
    names = ["ask_shard", "shard", "kind", "key", "vec", "pairs"]
    together = (vectors.select(names).unionByName(asks.select(names)).unionByName(pairs.select(names))
                .repartition("ask_shard", "shard").sortWithinPartitions("ask_shard", "shard", "kind"))
    schema = "key long, hit long, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in blocks_of(batches, 2):
            keys, hits, scores = rerank_block(rows, k)
            if len(keys):
                yield batch(schema, key=keys + (name[0] << ASK_SHARD_BITS), hit=hits + (name[1] << SHARD_BITS), score=scores)

    best = Window.partitionBy("key").orderBy(F.desc("score"), "hit")
    return (together.mapInArrow(work, schema)
            .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place"))


def rerank_block(rows: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and hits with their products. Vectors come first, then queries, then pairs."""
    vectors: dict[int, list] = {0: [], 1: []}
    at: dict[int, list] = {0: [], 1: []}
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    waiting: list[bytes] = []

    def products(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for kind, bits in ((0, SHARD_BITS), (1, ASK_SHARD_BITS)):
            if kind not in tables:
                row_of = np.zeros(1 << bits, np.int64)
                places_ = np.concatenate(at[kind]) & ((1 << bits) - 1)
                row_of[places_] = np.arange(len(places_))
                tables[kind] = row_of, np.concatenate(vectors[kind])
        ask, hit = (codes >> SHARD_BITS).astype(np.int64), (codes & ((1 << SHARD_BITS) - 1)).astype(np.int64)
        (hit_row, hit_vec), (ask_row, ask_vec) = tables[0], tables[1]
        some = 1 << 14
        score = np.concatenate([np.einsum("ij,ij->i", ask_vec[ask_row[ask[i:i + some]]], hit_vec[hit_row[hit[i:i + some]]])
                                for i in range(0, len(codes), some)])
        ask, hit, score = (np.concatenate(both) for both in zip(best, (ask, hit, score)))
        order = np.lexsort([hit, -score, ask])
        ask, hit, score = ask[order], hit[order], score[order]
        begins = np.concatenate([[True], ask[1:] != ask[:-1]])
        index = np.arange(len(ask))
        keep = index - np.maximum.accumulate(np.where(begins, index, 0)) <= k
        return ask[keep], hit[keep], score[keep]

    size = 0
    for part in rows:
        kinds = part["kind"].to_numpy()
        for kind in (0, 1):
            own = np.flatnonzero(kinds == kind)
            if len(own):
                own = part.slice(int(own[0]), len(own))
                at[kind].append(own["key"].to_numpy())
                vectors[kind].append(matrix(own["vec"]))
        for codes in part["pairs"].drop_null().to_pylist():
            waiting.append(codes)
            size += len(codes) // 4
            if size >= PAIRS_AT_ONCE:
                best = products(np.frombuffer(b"".join(waiting), "<u4"))
                waiting, size = [], 0
    return products(np.frombuffer(b"".join(waiting), "<u4")) if waiting else best
