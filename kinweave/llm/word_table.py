"""A table of the token ids of pieces of text, so that each different piece is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from kinweave.llm.common import slices, spread_ranges


class WordTable(dict):
    """Token ids of pieces, side by side in one array.

    ``encode_new`` gives all ids of some new pieces and how many each has. A table with more than
    ``most`` pieces forgets those seen once since it last did; where more than half would stay, all.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        super().__init__()
        self.encode_new, self.most = encode_new, most
        self.new: list[str] = []
        self.ids = np.empty(0, np.uint32)
        self.starts, self.lengths, self.seen = (np.empty(0, np.int64) for _ in range(3))

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place

    def forget(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if 2 * len(keep) > self.most:
            keep = keep[:0]
        names = list(self)
        self.clear()
        for place, old in enumerate(keep.tolist()):
            self[names[old]] = place
        starts, self.lengths = self.starts[keep], self.lengths[keep]
        self.ids = self.ids[spread_ranges(starts, self.lengths)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.seen = np.ones(len(keep), np.int64)

    def encode(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces of some texts in order, and how many each piece has."""
        if len(self) > self.most:
            self.forget()
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if self.new:
            flat, lengths = self.encode_new(self.new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, flat])
            self.new = []
        seen = np.bincount(places, minlength=len(self))
        seen[:len(self.seen)] += self.seen
        self.seen = seen
        lengths = self.lengths[places]
        return self.ids[spread_ranges(self.starts[places], lengths)], lengths

    def texts(self, texts: list[str], pieces_of: Callable[[str], list[str]]) -> Iterator[np.ndarray]:
        """The ids of each text, a bounded run of texts at a time."""
        for first, last in slices(texts):
            cut = [pieces_of(t) for t in texts[first:last]]
            ids, lengths = self.encode(cut)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            place = 0
            for pieces in cut:
                yield ids[ends[place]:ends[place + len(pieces)]]
                place += len(pieces)


class LineCoder:
    """Encode new pieces many in a line with the tokenizers library.

    ``simple`` says which pieces may share a line: each must be one pre-token there. ``marks`` tells the
    tokens that begin (or, with ``at_end``, end) such a piece. Where a line has as many marked tokens
    as pieces, they tell whose the tokens are; else its pieces are encoded one by one, like all others.
    """

    LINE = 200

    def __init__(self, path: str, simple: Callable[[str], object], between: str, marked: Callable[[str], bool],
                 at_end: bool, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        vocabulary = self.tool.get_vocab()
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[i for token, i in vocabulary.items() if marked(token)]] = True
        self.simple, self.between, self.at_end = simple, between, at_end
        self.table = WordTable(self.encode_new, most)

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple = np.array([bool(self.simple(p)) for p in pieces])
        plain, single = np.flatnonzero(simple), list(np.flatnonzero(~simple))
        order, flat, lengths = [], [], []
        lines = [plain[i:i + self.LINE] for i in range(0, len(plain), self.LINE)]
        for line, ids in zip(lines, self.batch([self.between.join(pieces[i] for i in line) for line in lines])):
            found = np.array(ids, np.uint32)
            at = np.flatnonzero(self.marks[found])
            if len(at) != len(line):
                single += list(line)
                continue
            order.append(line)
            flat.append(found)
            lengths.append(np.diff(at, prepend=-1) if self.at_end else np.diff(at, append=len(found)))
        found = self.batch([pieces[i] for i in single])
        order.append(np.array(single, np.int64))
        flat.append(np.fromiter((i for x in found for i in x), np.uint32))
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        back = np.argsort(np.concatenate(order))
        length = np.concatenate(lengths)
        start = np.cumsum(length) - length
        return np.concatenate(flat)[spread_ranges(start[back], length[back])], length[back]
