"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of ``n`` tokens attends to itself alone, so it costs ``n + n * n / even`` (linear layers plus
attention; both are equal at ``even`` tokens). Pieces come in descending order, each to the sequence
of the lowest cost so far that has room for it. A piece that no sequence has room for is cut: its
beginning fills the sequence of the lowest cost with any room, and the rest takes its turn again.

A task packs its own rows, ``BLOCK`` sequences at a time, and shuffles nothing. A block has just as
many sequences as it fills; what is over goes on to the next block. The last tokens of a task lie in
sequences of a power of two, which need no padding, so there is no padding at all.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinweave.llm.bpe import LETTERS, PIECES
from kinweave.llm.common import batch, id_and_text, small_batches
from kinweave.llm.word_table import LineCoder

LENGTH = 2048
#: Tokens at which attention costs as much as the linear layers: six times the width of the model.
EVEN = 12_288
#: Sequences packed at a time.
BLOCK = 512
SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, ids array<int>")

#: A piece: its document's number in the task, its first token there, its number of tokens.
Piece = tuple[int, int, int]


@lru_cache(maxsize=2)
def coder(path: str) -> LineCoder:
    """A byte-level tokenizer file. A word of letters with one blank before it is one pre-token, and
    only its first token begins with the blank."""
    return LineCoder(path, re.compile(f" [{LETTERS}]+").fullmatch, "", lambda token: token.startswith("Ġ"), False)


def encode(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text. Texts that hold an added token go to the library whole."""
    tool = coder(path)
    added = [t.content for t in tool.tool.get_added_tokens_decoder().values()]
    special = {i for i, t in enumerate(texts) if any(a in t for a in added)}
    plain = tool.table.texts(["" if i in special else t for i, t in enumerate(texts)], PIECES.findall)
    for i, ids in enumerate(plain):
        yield np.array(tool.batch([texts[i]])[0], np.uint32) if i in special else ids


def assign(pieces: list[Piece], sequences: int, length: int, even: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Deal pieces out to ``sequences`` sequences of ``length`` tokens: what each holds, and what is over.

    Equal lengths go in order of document and start, equal costs to the first sequence.
    """
    held: list[list[Piece]] = [[] for _ in range(sequences)]
    cost, room = np.zeros(sequences), np.full(sequences, length)
    waiting = [(-n, doc, start) for doc, start, n in pieces]
    heapq.heapify(waiting)
    over: list[Piece] = []
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
            if not fits.any():
                over.append((doc, start, n))
                continue
        to = int(np.where(fits, cost, np.inf).argmin())
        taken = min(n, int(room[to]))
        held[to].append((doc, start, taken))
        cost[to] += taken + taken * taken / even
        room[to] -= taken
        if taken < n:
            heapq.heappush(waiting, (taken - n, doc, start + taken))
    return held, over


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Cut pieces, in order, into sequences of falling powers of two: no padding."""
    left, out = sum(n for _, _, n in pieces), []
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, n = pieces.pop()
            taken = min(n, room)
            out[-1].append((doc, start, taken))
            room -= taken
            if taken < n:
                pieces.append((doc, start + taken, n - taken))
    return out


class Packer:
    """Packs the documents of one task; ``first`` is the number of its first sequence."""

    def __init__(self, length: int, even: float, first: int):
        self.length, self.even, self.next = length, even, first
        self.docs: dict[int, tuple] = {}
        self.pieces: list[Piece] = []
        self.full: list[list[Piece]] = []
        self.count = self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Whole sequences of a long document are full at once; the rest waits."""
        number, whole = self.count, len(ids) // self.length
        self.count += 1
        self.docs[number] = doc_id, ids
        self.full += [[(number, i * self.length, self.length)] for i in range(whole)]
        rest = len(ids) - whole * self.length
        if rest:
            self.pieces.append((number, whole * self.length, rest))
        self.waiting += len(ids)

    def pack(self, last: bool = False) -> pa.RecordBatch:
        """Pack all that waits, but for less than a sequence; the ``last`` time that too."""
        total = sum(n for _, _, n in self.pieces)
        held, over = assign(self.pieces, total // self.length, self.length, self.even)
        held = self.full + held + (powers(over) if last else [])
        self.pieces, self.full = [] if last else over, []
        out: list[tuple] = []
        for number, pieces in enumerate(held, self.next):
            ends = np.cumsum([n for _, _, n in pieces])
            for (doc, start, n), end in zip(pieces, ends):
                doc_id, ids = self.docs[doc]
                out.append((doc_id, start, n, len(ids), number, end - n, ends[-1], ids[start:start + n]))
        self.next += len(held)
        keep = {doc for doc, _, _ in self.pieces}
        self.docs = {doc: kept for doc, kept in self.docs.items() if doc in keep}
        self.waiting = sum(n for _, _, n in self.pieces)
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        columns = dict(zip(names, zip(*out))) if out else {name: [] for name in names}
        lists = columns.pop("ids")
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.uint32), *lists]).astype(np.int32)
        return batch(SCHEMA, ids=pa.ListArray.from_arrays(ends, flat), **{n: list(c) for n, c in columns.items()})


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int | None = 1, even: float = EVEN,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, sequence_tokens, ids``.

    Each whole text is encoded and ended with ``end_id``; ``start`` counts the ids of its document before
    the piece, ``offset`` those of its sequence. Every id is in one piece. A null text counts as empty:
    it has the end id alone (without one, no piece). Repeated rows and rows with a null id are documents
    of their own, other columns are not read, a text longer than a sequence fills several. An empty
    table gives an empty result. Which documents meet in a sequence depends on the partitions of
    ``docs``, and numbers of sequences are those of the partition and within it.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, even, TaskContext.get().partitionId() << 33)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for rows in batches:
            for doc_id, ids in zip(rows["doc_id"].to_pylist(), encode(tokenizer, rows["text"].to_pylist())):
                packer.add(doc_id, np.concatenate([ids, end]))
                if packer.waiting >= BLOCK * length:
                    yield packer.pack()
        yield packer.pack(last=True)

    return id_and_text(docs, id_column, text_column).mapInArrow(work, SCHEMA)


def piece_digests(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids, as little-endian 32-bit numbers, in place of the ids."""
    schema = SCHEMA.replace("ids array<int>", "ids_crc32 long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(rows.num_columns - 1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            names = rows.schema.names[:-1]
            yield batch(schema, ids_crc32=sums, **{n: rows[n] for n in names})

    return packed.mapInArrow(work, schema)
