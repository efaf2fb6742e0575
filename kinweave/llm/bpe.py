"""Byte-pair encoding and decoding with a contiguous rank array.

A pre-token is a short run of bytes. Its parts and the ranks of neighbouring parts lie in two short
lists: find the smallest rank (the leftmost of equal ones), delete the boundary between the two
parts, refresh the two neighbouring ranks, until no neighbours can merge. For a pre-token of more
than ``SHORT`` bytes, repeated scans would take quadratic time; there a heap over a linked list
gives the same merges in the same order.

Vocabulary, merges, pre-tokenizer and added tokens are read from a tokenizer file, which every
executor must have at the given path. Texts are taken apart at white space first, so that each
different piece is pre-tokenized and merged once and then looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import batch, id_and_text, slices, small_batches, spread_ranges

SHORT = 256
NEVER = 1 << 60
#: White space as Unicode defines it, not as Python does (which adds U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0  -     　"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: A plain word with the one blank before it; stops after it; any other word; what is left of the
#: white space. The pre-tokenizer never looks back, so each piece may hold any whole pre-tokens.
PIECES = re.compile(f" ?[{LETTERS}]++(?![^\\x00-\\x7f])|[,.!?]++(?![^{SPACE}])"
                    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(f" ?[{LETTERS}]+").fullmatch


class PieceTable(dict):
    """Ids of pieces of text, each worked out once; emptied when it holds more than ``most``."""

    def __init__(self, encode_pieces: Callable[[list], list], most: int = 400_000):
        super().__init__()
        self.encode_pieces, self.most = encode_pieces, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list = []
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def __missing__(self, piece):
        place = self[piece] = len(self)
        self.new.append(piece)
        return place

    def encode(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each piece has."""
        if len(self) > self.most:
            self.reset()
        places = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            found = self.encode_pieces(self.new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, *(np.asarray(x, np.uint32) for x in found)])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
            self.new = []
        lengths = self.lengths[places]
        return self.ids[spread_ranges(self.starts[places], lengths)], lengths


def encode_texts(texts: list[str], pieces_of: Callable[[str], list], table: PieceTable) -> Iterator[np.ndarray]:
    """The ids of each text, a bounded run of texts at a time."""
    for first, last in slices(texts):
        cut = [pieces_of(t) for t in texts[first:last]]
        ids, lengths = table.encode([p for pieces in cut for p in pieces])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = 0
        for pieces in cut:
            yield ids[ends[place]:ends[place + len(pieces)]]
            place += len(pieces)


class Merges:
    """Ranks of pairs of ids, and the id that each rank makes."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.made = [new for _, _, new in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}

    def short(self, ids: list[int]) -> list[int]:
        """Merge in place: ``near[i]`` is the rank of parts ``i`` and ``i + 1``."""
        rank_of = self.ranks.get
        near = [rank_of(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while near:
            best = min(near)
            if best == NEVER:
                break
            i = near.index(best)
            new = ids[i] = self.made[best]
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = rank_of(ids[i - 1] << 32 | new, NEVER)
            if i < len(near):
                near[i] = rank_of(new << 32 | ids[i + 1], NEVER)
        return ids

    def long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, with a heap of (rank, place) over a linked list."""
        end, after, before = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int]] = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else end
            if right < end and (rank := self.ranks.get(ids[left] << 32 | ids[right])) is not None:
                heapq.heappush(heap, (rank, left))

        for i in range(end):
            offer(i)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= end or self.ranks.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Codec:
    """A byte-level BPE tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, steps = spec["model"]["vocab"], spec["pre_tokenizer"]
        if steps["type"] != "ByteLevel" or spec["normalizer"] is not None or steps["add_prefix_space"]:
            raise ValueError("not a plain byte-level tokenizer file")
        # The file's own pre-tokenizer, so that its tables of letters and digits are the ones used.
        self.pre_tokenize = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        letters = byte_letters()
        self.of_letter = {letter: vocabulary[letter] for letter in letters}
        self.of_byte = [vocabulary[letter] for letter in letters]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.merges = Merges([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.bytes |= {i: token.encode() for token, i in self.added.items()}
        self.table = PieceTable(lambda pieces: [self.encode_piece(p) for p in pieces])

    def encode_piece(self, piece: str | tuple) -> list[int]:
        if isinstance(piece, tuple):
            return [piece[0]]
        if PLAIN(piece):  # one pre-token
            return self.merge([self.of_byte[b] for b in piece.encode()])
        out: list[int] = []
        for letters, _ in self.pre_tokenize(piece):
            out += self.merge([self.of_letter[c] for c in letters])
        return out

    def merge(self, ids: list[int]) -> list[int]:
        return self.merges.short(ids) if len(ids) <= SHORT else self.merges.long(ids)

    def pieces_of(self, text: str) -> list:
        """Pieces of the text; an added token is a piece of its own, held as its id."""
        if not any(token in text for token in self.added):
            return PIECES.findall(text)
        out: list = []
        for part in self.cut_added.split(text):
            out += [(self.added[part],)] if part in self.added else PIECES.findall(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return encode_texts(texts, self.pieces_of, self.table)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the others for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each whole text: ``doc_id, ids``.

    A null text counts as empty; an empty one has no ids. Repeated rows give repeated results; other
    columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for rows in batches:
            ids = list(tool.encode(rows["text"].to_pylist()))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            yield batch(schema, doc_id=rows["doc_id"], ids=pa.ListArray.from_arrays(ends, flat))

    return id_and_text(docs, id_column, text_column).mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Decode ``ids`` to ``text``: ``doc_id, text``. Bytes that are no UTF-8 become U+FFFD.

    Null ids count as none, null entries of a list are left out.
    """
    small_batches(encoded.sparkSession)
    schema = "doc_id long, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for rows in batches:
            texts = [tool.decode(np.array([i for i in x.as_py() or () if i is not None], np.int64)) for x in rows["ids"]]
            yield batch(schema, doc_id=rows["doc_id"], text=texts)

    return encoded.select("doc_id", "ids").mapInArrow(work, schema)


def digest_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids again, and give digests of both:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256, same``; ``same`` says that decoding gave the text back.
    With ``with_ids``, the ids themselves come last."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean"
    schema += ", ids array<int>" if with_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for rows in batches:
            texts = rows["text"].to_pylist()
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "same": [], "ids": []}
            for text, ids in zip(texts, tool.encode(texts)):
                decoded = tool.decode(ids)
                out["ids"].append(ids.astype(np.int32) if with_ids else None)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["same"].append(decoded == text)
            yield batch(schema, doc_id=rows["doc_id"], **out)

    return id_and_text(docs, id_column, text_column).mapInArrow(work, schema)
