"""Merkle manifest of a data set: a tree of SHA-256 digests whose parents keep copied hash states.

A leaf is the digest of a row. Rows of a group, in order, make a tree with three children a parent,
and the roots of the groups, in order, make another one, whose root names the whole data set. A parent
is the digest of its children's digests as hexadecimal text. Each of these is 64 bytes, just one block
of SHA-256, so the hash state before a child is eight numbers with nothing pending, and a parent keeps
a copy of it for each child slot. To fold a replaced child, the state of its slot is resumed with the
replacement and the siblings right of it; what lies left of it is never hashed again.

Trees are built in storeys. A storey cuts each tree into chunks of ``3 ** HEIGHT`` nodes; a task turns
one chunk into one row with all its digests and states, and the chunks' roots are the next storey. So
a group of any size is spread over many tasks, and there are ``log(n) / log(3 ** HEIGHT)`` storeys.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.llm.common import batch
from kinweave.llm.places import name_of, with_places

#: Levels that one storey adds at most.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _cube_root(x: int) -> int:
    root = 1 << -(-x.bit_length() // 3)
    while root ** 3 > x:
        root = (2 * root + x // (root * root)) // 3
    return root


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, isqrt(n) + 1))]
#: The constants of SHA-256: the first 32 bits behind the point of square and cube roots of primes.
BEGIN = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)[:, None]
ROUNDS = [_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES[:64]]
_digits = np.arange(1 << 16, dtype=np.uint32)[:, None] >> np.array([12, 8, 4, 0], np.uint32) & 15
#: Four hexadecimal digits of a 16-bit number, as one number of four characters.
HEX = (np.where(_digits < 10, _digits + 48, _digits + 87) << np.array([24, 16, 8, 0], np.uint32)).sum(1).astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> n) | (x << (32 - n))


def resume(state: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    """The states (8 by n) after one more block each (16 columns of n numbers, or of one for all)."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> 3)) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> 10)))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + ROUNDS[i])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def text_block(digests: np.ndarray) -> list[np.ndarray]:
    """Digests (8 by n) as a block of hexadecimal text."""
    return [HEX[half] for word in digests for half in (word >> 16, word & 0xFFFF)]


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of states that have taken in so many whole blocks."""
    zero = np.zeros(1, np.uint32)
    return resume(state, [np.array([1 << 31], np.uint32), *[zero] * 13, (blocks >> 23).astype(np.uint32),
                          (blocks << 9 & 0xFFFFFFFF).astype(np.uint32)])


def to_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32)


def to_bytes(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


def hex_digests(words: np.ndarray) -> list[str]:
    text = to_bytes(words).hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


class Chunk:
    """Digests of each level of a chunk (8 by n), and each parent's states before its slots (3 by 8 by n)."""

    def __init__(self, levels: list[np.ndarray], states: list[np.ndarray]):
        self.levels, self.states = levels, states

    @classmethod
    def grow(cls, leaves: np.ndarray, height: int | None) -> Chunk:
        """Build ``height`` levels, or as many as it takes to one root."""
        levels, states = [leaves], []
        while levels[-1].shape[1] > 1 if height is None else len(states) < height:
            below = levels[-1]
            n, parents = below.shape[1], -(-below.shape[1] // 3)
            state, kept = np.repeat(BEGIN, parents, 1), np.zeros((3, 8, parents), np.uint32)
            for slot in range(3):
                child = below[:, slot::3]
                kept[slot] = state
                state[:, :child.shape[1]] = resume(state[:, :child.shape[1]], text_block(child))
            levels.append(finish(state, np.minimum(3, n - 3 * np.arange(parents))))
            states.append(kept)
        return cls(levels, states)

    def pack(self) -> tuple[bytes, bytes]:
        return (b"".join(map(to_bytes, self.levels)),
                b"".join(s.astype(">u4").tobytes() for s in self.states))

    @classmethod
    def unpack(cls, size: int, height: int, digests: bytes, states: bytes) -> Chunk:
        levels, kept, at, of = [], [], 0, 0
        for level in range(height + 1):
            levels.append(np.frombuffer(digests, ">u4", 8 * size, at).reshape(size, 8).T.astype(np.uint32))
            at += 32 * size
            size = -(-size // 3)
            if level < height:
                kept.append(np.frombuffer(states, ">u4", 24 * size, of).reshape(3, 8, size).astype(np.uint32))
                of += 96 * size
        return cls(levels, kept)

    def steps(self, places: np.ndarray) -> list[tuple]:
        """What folding from these places needs, level by level: slot, number of children, state before the
        slot, and the digests of all children (those that are missing repeat another)."""
        out = []
        for below, kept in zip(self.levels, self.states):
            parent, slot = places // 3, places % 3
            count = np.minimum(3, below.shape[1] - 3 * parent)
            children = [below[:, np.minimum(3 * parent + i, below.shape[1] - 1)] for i in range(3)]
            out.append((slot, count, kept[slot, :, parent].T, children))
            places = parent
        return out


def fold(digests: np.ndarray, proof: np.ndarray, blocks: np.ndarray, steps: list[tuple]) -> tuple:
    """Fold replaced nodes along their steps: their root, the state of the proof, and its number of blocks.

    A step resumes the state of the node's slot with the node and the siblings right of it. The proof
    takes in all siblings, left to right.
    """
    n = digests.shape[1]
    for slot, count, state, children in steps:
        slot, count = np.broadcast_to(slot, n), np.broadcast_to(count, n)
        state, proof, blocks = resume(state, text_block(digests)), proof.copy(), blocks.copy()
        for i, child in enumerate(children):
            right, other = np.flatnonzero((i > slot) & (i < count)), np.flatnonzero((i != slot) & (i < count))
            child = np.broadcast_to(child, (8, n))
            if len(right):
                state[:, right] = resume(state[:, right], text_block(child[:, right]))
            if len(other):
                proof[:, other] = resume(proof[:, other], text_block(child[:, other]))
                blocks[other] += 1
        digests = finish(state, count)
    return digests, proof, blocks


#: Bytes of a step in a path: slot, number of children, state, three digests.
STEP = 2 + 4 * 32


def write_steps(steps: list[tuple], n: int) -> np.ndarray:
    """Steps of n nodes as rows of bytes."""
    out = np.zeros((n, len(steps), STEP), np.uint8)
    for i, (slot, count, state, children) in enumerate(steps):
        out[:, i, 0], out[:, i, 1] = slot, count
        for j, words in enumerate([state, *children]):
            out[:, i, 2 + 32 * j:34 + 32 * j] = np.frombuffer(to_bytes(words), np.uint8).reshape(n, 32)
    return out.reshape(n, -1)


def read_steps(path: bytes) -> list[tuple]:
    """Steps that all nodes of a chunk have in common."""
    out = []
    for at in range(0, len(path), STEP):
        words = [to_words([path[at + 2 + 32 * j:at + 34 + 32 * j]]) for j in range(4)]
        out.append((path[at], path[at + 1], words[0], words[1:]))
    return out


CHUNKS = "tree string, chunk long, size long, height long, digests binary, states binary, root binary"


def grow_storey(nodes: DataFrame) -> DataFrame:
    """``tree, place, digest`` to a row per chunk.

    The first chunk of a tree is its only one if it is not full, and then grows to one root; all others
    grow by ``HEIGHT`` levels, which is the same for a full one.
    """
    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        chunk = rows["chunk"][0].as_py()
        grown = Chunk.grow(to_words(rows["digest"].to_pylist()), None if chunk == 0 else HEIGHT)
        digests, states = grown.pack()
        return pa.Table.from_batches([batch(CHUNKS, tree=[rows["tree"][0].as_py()], chunk=[chunk], size=[len(rows)],
                                            height=[len(grown.states)], digests=[digests], states=[states],
                                            root=[digests[-32:]])])

    return (nodes.withColumn("chunk", F.floor(F.col("place") / 3 ** HEIGHT)).groupBy("tree", "chunk")
            .applyInArrow(work, CHUNKS))


def grow_trees(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All storeys of the trees over ``tree, place, digest``, and their roots: ``tree, root``."""
    storeys, roots = [], None
    while True:
        storeys.append(cut(grow_storey(nodes)))
        found = storeys[-1].select("tree", "chunk", "root")
        unfinished = cut(found.groupBy("tree").agg(F.count("*").alias("n")).filter("n > 1").select("tree"))
        done = found.join(unfinished, "tree", "left_anti").select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        if unfinished.isEmpty():
            return storeys, roots
        nodes = found.join(unfinished, "tree").select("tree", F.col("chunk").alias("place"), F.col("root").alias("digest"))


def with_above(chunks: DataFrame, nodes: DataFrame | None, trees: DataFrame) -> DataFrame:
    """Chunks with ``above``, the path from their root to the root of all: that of the node which their
    root is in the next storey, or where their tree ends, that of the tree."""
    found = chunks.join(trees.withColumnRenamed("path", "of_tree"), "tree")
    if nodes is None:
        return found.withColumn("above", F.col("of_tree")).drop("of_tree")
    return (found.join(nodes.select("tree", F.col("place").alias("chunk"), "path"), ["tree", "chunk"], "left")
            .withColumn("above", F.coalesce("path", "of_tree")).drop("path", "of_tree"))


def node_paths(chunks: DataFrame) -> DataFrame:
    """``tree, place, path`` of the nodes below each chunk's root."""
    schema = "tree string, place long, path binary"

    def work(batches):
        for rows in batches:
            for row in rows.to_pylist():
                chunk = Chunk.unpack(row["size"], row["height"], row["digests"], row["states"])
                steps = write_steps(chunk.steps(np.arange(row["size"])), row["size"])
                yield batch(schema, tree=[row["tree"]] * row["size"], path=[x.tobytes() + row["above"] for x in steps],
                            place=row["chunk"] * 3 ** HEIGHT + np.arange(row["size"]))

    return chunks.mapInArrow(work, schema)


def all_paths(storeys: list[DataFrame], trees: DataFrame) -> DataFrame:
    """The lowest storey's chunks with the path from each one's root to the root of all."""
    nodes = None
    for chunks in storeys[:0:-1]:
        nodes = cut(node_paths(with_above(chunks, nodes, trees)))
    return with_above(storeys[0], nodes, trees)


@dataclass
class Manifest:
    """``leaves`` (tree, place, digest and the columns that came with them), the ``storeys`` of the groups'
    trees and of the tree over their roots (``top``), the groups' roots ``subroots`` (name, place, root), and
    the root of all (None for an empty table)."""

    leaves: DataFrame
    storeys: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def leaf_digest(columns: dict[str, Column]) -> Column:
    """A row's digest, binary: each value as its length in bytes, a colon and its text; a null as ``-``."""
    parts = [c.cast("string") for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                                     for c in parts)), 256))


def build_manifest(rows: DataFrame, group: str, order: list[str], digest: str) -> Manifest:
    """The manifest of rows that carry their leaf digest (binary); all their columns stay with the leaves.

    Groups are ordered by ``group``, null first; leaves within one by ``order`` (nulls first), then by
    digest, so repeated rows and ties have a fixed order. An empty table gives an empty manifest. The
    names ``tree``, ``place`` and ``chunk`` are taken.
    """
    leaves = cut(with_places(rows.withColumn("tree", name_of(F.col(group))), "tree", [*order, digest]))
    storeys, roots = grow_trees(leaves.select("tree", "place", F.col(digest).alias("digest")))
    subroots = cut(roots)
    groups = with_places(subroots.select(F.lit("").alias("all"), "tree", "root"), "all", ["tree"])
    top, root = grow_trees(groups.select(F.col("all").alias("tree"), "place", F.col("root").alias("digest")))
    found = root.first()
    named = cut(groups.select(F.col("tree").alias("name"), "place", "root"))
    return Manifest(leaves, storeys, top, named, found["root"].hex() if found else None)


def fold_replaced(manifest: Manifest, digest: str, replaced: str, keep: list[str]) -> DataFrame:
    """For each leaf, its digest, subroot, root, the proof (digest of all siblings up to the root) and
    ``folded_root``: the root when only this leaf is replaced by the digest in column ``replaced``."""
    spark = manifest.leaves.sparkSession
    fields = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in manifest.leaves.schema.fields}
    schema = ", ".join([*(f"{c} {fields[c]}" for c in keep),
                        "leaf string, subroot string, root string, proof_sha256 string, folded_root string"])
    if manifest.root is None:
        return spark.createDataFrame([], schema)
    nothing = spark.createDataFrame([("", b"")], "tree string, path binary")
    of_group = node_paths(all_paths(manifest.top, nothing)).select("place", "path")
    trees = cut(manifest.subroots.join(of_group, "place").select(F.col("name").alias("tree"), "root", "path"))
    chunks = (all_paths(manifest.storeys, trees.select("tree", "path"))
              .join(trees.select("tree", F.col("root").alias("subroot")), "tree"))
    root = manifest.root

    def work(leaves: pa.Table, chunk: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        held = Chunk.unpack(row["size"], row["height"], row["digests"], row["states"])
        places = leaves["place"].to_numpy() - row["chunk"] * 3 ** HEIGHT
        n = len(places)
        folded, proof, blocks = fold(to_words(leaves[replaced].to_pylist()), np.repeat(BEGIN, n, 1), np.zeros(n, np.int64),
                                     held.steps(places) + read_steps(row["above"]))
        return pa.Table.from_batches([batch(
            schema, **{c: leaves[c].to_pylist() for c in keep}, leaf=hex_digests(held.levels[0][:, places]),
            subroot=[row["subroot"].hex()] * n, root=[root] * n, proof_sha256=hex_digests(finish(proof, blocks)),
            folded_root=hex_digests(folded))])

    leaves = manifest.leaves.withColumn("chunk", F.floor(F.col("place") / 3 ** HEIGHT))
    return (leaves.select(*keep, replaced, "tree", "place", "chunk").groupBy("tree", "chunk")
            .cogroup(chunks.groupBy("tree", "chunk")).applyInArrow(work, schema))


def document_leaves(docs: DataFrame, changed_text: Column) -> DataFrame:
    """``doc_id, source, leaf, changed``: the digest of each document, and that with ``changed_text``.

    Null values are told from empty ones. Other columns are not read.
    """
    rows = docs.select(*(docs[c] for c in FIELDS)).withColumn("new_text", changed_text)
    own = {c: F.col(c) for c in FIELDS}
    changed = F.when(F.col("new_text").eqNullSafe(F.col("text")), F.col("leaf")).otherwise(
        leaf_digest(own | {"text": F.col("new_text")}))
    return (rows.withColumn("leaf", leaf_digest(own)).withColumn("changed", changed)
            .select("doc_id", "source", "leaf", "changed"))
