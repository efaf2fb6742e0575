"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature holds ``CHUNKS * PLACES`` entries of 16 bits, one per hash function. Its distance to
another is the number of entries that differ. With ``CHUNKS`` chunks and at most
``CHUNKS * (errors + 1) - 1`` differing entries, some chunk has at most ``errors`` of them
(pigeonhole); leaving out each choice of ``errors`` places of a chunk enumerates all ways they can
fall. So two signatures within that distance share a key, whatever the data. With 8 chunks of 4 and
one error that is distance 15 of 32: texts with similarity 0.85 go beyond it with a probability of
2e-6, with 0.8 of 2e-4.

The keys only propose; every link is confirmed on the full sets. Texts with the same set are one
class from the start, and keys held by the very same classes count once. First each class is compared
with one other of each of its keys, which joins most of what belongs together. Then, within each key,
all classes outside its largest component are compared with all others, block by block: a block of
sets is one small matrix, and a product of two such matrices gives all their overlaps. No pair is
written; a block gives back only the links that join components. No pair of a key is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.llm.common import batch, id_and_text, small_batches
from kinweave.llm.components import components
from kinweave.llm.shingles import factors, overlap, shingle_sets, signature

CHUNKS, PLACES, BITS = 8, 4, 16
#: Up to so many document ids (8 bytes each) are sent to all executors; beyond, texts are shuffled.
SENT_IDS = 1_000_000
#: Nodes and shingles of a block, and columns of its matrix at a time.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 1024, 500_000, 2048


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig`` of ``doc_id, text``; a pass over each text."""
    schema = "doc_id long, n_shingles long, set_key binary, sig binary"
    scale, shift = factors(CHUNKS * PLACES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, keys, sigs = [], [], []
            for values in shingle_sets(rows["text"].to_pylist(), width):
                sizes.append(len(values))
                keys.append(hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest())
                sigs.append(signature(values, scale, shift, BITS).astype(">u2").tobytes())
            yield batch(schema, doc_id=rows["doc_id"], n_shingles=sizes, set_key=keys, sig=sigs)

    return docs.mapInArrow(work, schema)


def chunk_keys(classes: DataFrame, errors: int = 1) -> DataFrame:
    """``key, node`` for each chunk of ``sig`` and each choice of ``errors`` places left out of it."""
    size = BITS // 8
    keys, number = [], 0
    for chunk in range(CHUNKS):
        for left_out in combinations(range(PLACES), errors):
            parts = [F.substring("sig", (chunk * PLACES + i) * size + 1, size) for i in range(PLACES) if i not in left_out]
            keys.append(F.xxhash64(F.lit(number), *parts))
            number += 1
    return classes.select(F.explode(F.array(*keys)).alias("key"), "node")


def distance(a: F.Column, b: F.Column) -> F.Column:
    """The number of entries in which two signatures differ."""
    size = BITS // 8
    return sum((F.substring(a, i * size + 1, size) != F.substring(b, i * size + 1, size)).cast("int")
               for i in range(CHUNKS * PLACES))


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    per_mille = round(similarity * 1000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for x, y in zip(rows["set_a"], rows["set_b"]):
                one, two = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                shared = overlap(one, two)
                keep.append(1000 * shared >= per_mille * (len(one) + len(two) - shared))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, errors: int = 1,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles:
    ``doc_id, n_shingles, component_id, kept``.

    A text with fewer words than ``width`` has one shingle, its words; a null text or one without
    words has none and is linked with nothing. The component is the smallest id that links reach,
    and only that document is kept. Ids are integers. Repeated rows count as one document, an id with
    several texts joins their groups, rows without an id are left out, very long texts are read whole,
    an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = id_and_text(docs, id_column, text_column).filter("doc_id IS NOT NULL")
    found = cut(sketches(texts, width))
    # A class of texts is named by the key of their set; document ids come back at the end.
    shown = found.filter("n_shingles > 0").withColumnRenamed("set_key", "node")
    classes = cut(shown.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    # One document with several texts is in several classes: a link from the start.
    first = shown.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("doc_id", "a")
    several = shown.join(first, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    linked = link_classes(chunk_keys(classes, errors).distinct(), classes, texts, width, similarity)
    groups = components(several if linked is None else several.unionByName(linked))
    named = classes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # The texts of one document are in one component.
    of_document = (shown.groupBy("doc_id").agg(F.min("node").alias("node")).join(named.select("node", "component"), "node")
                   .join(names, "component").select("doc_id", "component_id"))
    return (found.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(of_document, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def distinct_keys(keys: DataFrame) -> DataFrame:
    """Keys with two nodes or more, one of those that the very same nodes hold."""
    first, second = (F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")) for i in (1, 2))
    held = keys.groupBy("key").agg(F.count("*").alias("n"), first.alias("one"), second.alias("two"), F.min("node").alias("least"))
    kept = held.filter("n > 1").groupBy("n", "one", "two", "least").agg(F.min("key").alias("key"))
    return keys.join(kept.select("key"), "key", "left_semi")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, errors: int = 1,
                         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without the documents that are not kept.

    Rows without an id stay. Of rows that share an id, the first by text stays.
    """
    groups = near_duplicates(docs, width, similarity, errors, id_column, text_column)
    gone = cut(groups.filter("NOT kept").select(F.col("doc_id").alias(id_column)))
    repeated = cut(docs.groupBy(id_column).agg(F.count("*").alias("rows"))
                   .filter(F.col(id_column).isNotNull() & (F.col("rows") > 1)).select(id_column))
    left = docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, id_column, "left_anti")
    count = repeated.count()
    if count:
        chosen = F.broadcast(repeated) if count <= SENT_IDS else repeated
        first = Window.partitionBy(id_column).orderBy(text_column)
        place = "place" + "_" * max(map(len, docs.columns))  # no column of docs has this name
        once = (left.join(chosen, id_column, "left_semi").withColumn(place, F.row_number().over(first))
                .filter(F.col(place) == 1).drop(place))
        left = left.join(chosen, id_column, "left_anti").unionByName(once.select(left.columns))
    return left.select(docs.columns)


def link_classes(keys: DataFrame, classes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """Links ``a, b`` between classes that share a key: enough to connect all that are linked."""
    open_keys = cut(distinct_keys(keys))
    nodes = cut(open_keys.select("node").distinct())
    count = nodes.count()
    if not count:
        return None
    # The text of a class's smallest document id gives its set.
    readers = cut(classes.join(nodes, "node", "left_semi").select(F.col("least").alias("doc_id")).distinct())
    chosen = F.broadcast(readers) if count <= SENT_IDS else readers
    sets = cut(set_bytes(texts.join(chosen, "doc_id", "left_semi"), width).join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    per_mille = round(similarity * 1000)
    hubs = open_keys.groupBy("key").agg(F.min("node").alias("hub"))
    pairs = (open_keys.join(hubs, "key").filter("node <> hub")
             .select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    facts = classes.select("node", "n", "sig")
    one = facts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = facts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    likely = (pairs.join(one, "a").join(two, "b")
              .filter(F.least("n_a", "n_b") * 1000 >= per_mille * F.greatest("n_a", "n_b"))
              .filter(distance(F.col("sig_a"), F.col("sig_b")) < CHUNKS * 2).select("a", "b"))
    linked = cut(confirm(likely, sets, similarity))
    labels = cut(nodes.join(components(linked), "node", "left")
                 .select("node", F.coalesce("component", "node").alias("component")))
    rest = cut(block_links(blocks(open_keys, labels, classes), sets, per_mille))
    return linked.unionByName(rest)


def blocks(open_keys: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, one, two, node, component, side``: the rows of each pair of blocks to be compared.

    The largest component of a key lies in the blocks from 0 up, all others in the blocks from -1
    down, each block with about ``BLOCK_NODES`` nodes or ``BLOCK_SHINGLES`` shingles. Compared are the
    latter with each other and with the former, which already are linked with each other.
    """
    named = open_keys.join(labels, "node").join(classes.select("node", "n"), "node")
    parts = named.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    sizes = parts.groupBy("key").agg(
        F.max(F.struct("m", "component", "weight")).alias("top"), F.sum("m").alias("m"), F.sum("weight").alias("weight"))

    def many(m: F.Column, weight: F.Column) -> F.Column:
        return F.greatest(F.ceil(m / BLOCK_NODES), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")

    sizes = (sizes.filter(F.col("m") > F.col("top.m"))
             .select("key", F.col("top.component").alias("top"), many(F.col("top.m"), F.col("top.weight")).alias("inside"),
                     many(F.col("m") - F.col("top.m"), F.col("weight") - F.col("top.weight")).alias("outside")))
    at = F.xxhash64("node", F.lit(3))
    placed = (named.join(sizes, "key").withColumn("block", F.when(
        F.col("component") == F.col("top"), F.pmod(at, F.col("inside"))).otherwise(-1 - F.pmod(at, F.col("outside")))
        .cast("int")))
    outer = F.sequence(-F.col("outside"), F.lit(-1))
    partners = F.when(F.col("block") >= 0, outer).otherwise(F.concat(outer, F.sequence(F.lit(0), F.col("inside") - 1)))
    return (placed.withColumn("partner", F.explode(partners))
            .select("key", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("two"),
                    "node", "component", (F.col("block") > F.col("partner")).alias("side")).distinct())


def block_links(rows: DataFrame, sets: DataFrame, per_mille: int) -> DataFrame:
    """Links that join components within each pair of blocks; at most one fewer than it has nodes."""
    together = (rows.join(sets, "node").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
                .select("key", "one", "two", "node", "component", "side", "members"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None
        found: list[tuple[bytes, bytes]] = []
        for part in batches:
            for row in zip(*(part.column(i).to_pylist() for i in range(7))):
                if row[:3] != name:
                    found += joining_links(held, name, per_mille)
                    held, name = [], row[:3]
                held.append(row[3:])
            if found:
                yield batch("a binary, b binary", a=[a for a, _ in found], b=[b for _, b in found])
                found = []
        found = joining_links(held, name, per_mille)
        yield batch("a binary, b binary", a=[a for a, _ in found], b=[b for _, b in found])

    return together.mapInArrow(work, "a binary, b binary")


def joining_links(rows: list[tuple], name: tuple | None, per_mille: int) -> list[tuple[bytes, bytes]]:
    """Of the linked pairs among ``(node, component, side, members)``, those that join components.

    ``name`` is (key, one block, other block): the same block twice, or two, of which one may be empty.
    """
    if len(rows) < 2:
        return []
    sides = np.array([r[2] for r in rows])
    one, two = (np.flatnonzero(~sides), np.flatnonzero(sides)) if name[1] != name[2] else (np.arange(len(rows)),) * 2
    if not len(one) or not len(two):
        return []
    sets = [np.frombuffer(r[3], "<u8") for r in rows]
    sizes = np.array(list(map(len, sets)))
    shared = overlaps(sets, one, two)
    linked = 1000 * shared >= per_mille * (sizes[one][:, None] + sizes[two][None, :] - shared)
    above = {r[1]: r[1] for r in rows}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    found = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = rows[one[i]], rows[two[j]]
        x, y = root(a[1]), root(b[1])
        if x != y:
            above[max(x, y)] = min(x, y)
            found.append((a[0], b[0]))
    return found


def overlaps(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of ``one`` with each of ``two``."""
    if len(one) * len(two) <= 16:
        return np.array([[overlap(sets[i], sets[j]) for j in two] for i in one])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1  # what only one set holds overlaps with nothing
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    keep = counts[place] > 1
    owner, column = owner[keep], rank[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(one), len(two)))
    for begin in range(0, int(rank[-1]) + 1, COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[low:high], column[low:high] - begin] = 1
        total += held[one] @ held[two].T
    return np.where(one[:, None] == two[None, :], 0, total.astype(np.int64))


def set_bytes(docs: DataFrame, width: int) -> DataFrame:
    """``node, members``: the full set of each text as sorted 64-bit numbers, under its key."""
    schema = "node binary, members binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            members = [v.astype("<u8").tobytes() for v in shingle_sets(rows["text"].to_pylist(), width)]
            keys = [hashlib.blake2b(m, digest_size=16).digest() for m in members]
            yield batch(schema, node=keys, members=members)

    return docs.select("doc_id", "text").mapInArrow(work, schema)
