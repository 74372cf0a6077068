"""Lattices of all segmentations of many short strings into pieces of a fixed vocabulary.

Strings are the units of a SentencePiece text: a run of ``▁`` and what follows it. No piece of the
vocabulary spans two units, so the segmentations of a text are the products of those of its units.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

MARK = "▁"
#: Units: a run of marks with the characters up to the next mark; a line feed is no part of any piece.
UNIT = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Unknown characters get ids from here on: UNKNOWN + code point.
UNKNOWN = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of a SentencePiece model, found by a 64-bit polynomial hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(size)]
        self.pieces = {self.model.id_to_piece(i): i for i in range(size) if not special[i]}
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size = size
        self.longest = max(map(len, self.pieces))
        bits = 18
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.ids = np.full(1 << bits, -1, dtype=np.int32)
        for piece, i in self.pieces.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * _FACTOR + np.uint64(ord(c) + 1)
                at = (h * _FACTOR) >> self.shift
                while self.ids[at] >= 0:
                    at = (at + np.uint64(1)) & self.mask
            self.keys[at], self.ids[at] = h, i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for none."""
        with np.errstate(over="ignore"):
            at = (hashes * _FACTOR) >> self.shift
        out = np.full(len(hashes), -1, dtype=np.int32)
        open_ = np.arange(len(hashes))
        while len(open_):
            ids = self.ids[at[open_]]
            same = (self.keys[at[open_]] == hashes[open_]) & (ids >= 0)
            out[open_[same]] = ids[same]
            open_ = open_[~same & (ids >= 0)]
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
        return out

    @cached_property
    def joins(self) -> np.ndarray:
        """Pairs of neighbours inside pieces as numbers, in order."""
        return np.array(sorted({ord(a) << 21 | ord(b) for piece in self.pieces for a, b in zip(piece, piece[1:])}), dtype=np.int64)

    def parts(self, strings: list[str]) -> tuple[list[str], np.ndarray]:
        """Strings (none empty) cut where no piece reaches across, in a row, and where in that row each string begins. The
        segmentations of a string are the products of those of its parts."""
        whole = "".join(strings)
        chars = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        pairs = chars[:-1] << 21 | chars[1:]
        begins = np.ones(len(chars), dtype=bool)
        at = np.minimum(np.searchsorted(self.joins, pairs), len(self.joins) - 1)
        begins[1:] = self.joins[at] != pairs
        lengths = np.array([len(x) for x in strings], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        begins[first] = True
        cuts = np.flatnonzero(begins).tolist()
        return [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)])], np.cumsum(begins)[first] - 1

    def normalised(self, text: str) -> str:
        """As the model sees a text: a mark in front, marks for spaces."""
        return MARK + text.replace(" ", MARK) if text else ""


class Arcs:
    """All arcs of the lattices of strings, with node numbers over all strings: string k has the nodes
    first[k] .. first[k] + length[k]. Arcs are sorted by where they start."""

    def __init__(self, strings: list[str], vocabulary: Vocabulary):
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.length = lengths
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.nodes = int((lengths + 1).sum())
        chars = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        owner = np.repeat(np.arange(len(strings)), lengths)
        place = np.arange(len(chars)) - starts[owner]
        left = lengths[owner] - place
        codes = chars.astype(np.uint64) + np.uint64(1)
        node = self.first[owner] + place
        froms, tos, ids = [], [], []
        at, h = np.arange(len(chars)), np.zeros(len(chars), dtype=np.uint64)
        for n in range(1, vocabulary.longest + 1):
            fits = left[at] >= n
            at, h = at[fits], h[fits]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                h = h * _FACTOR + codes[at + n - 1]
            found = vocabulary.find(h)
            if n == 1:
                found = np.where(found < 0, (UNKNOWN + chars[at]).astype(np.int32), found)
            hit = found >= 0
            froms.append(node[at[hit]])
            tos.append(node[at[hit]] + n)
            ids.append(found[hit])
        if froms:
            start = np.concatenate(froms)
            order = np.argsort(start, kind="stable")
            self.start, self.end, self.piece = start[order], np.concatenate(tos)[order], np.concatenate(ids)[order]
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.piece = np.zeros(0, dtype=np.int32)

    def by_place(self):
        """Arc numbers grouped by the place (in its string) of the node where they end, in order."""
        of = np.repeat(self.first, self.length + 1)
        place = self.end - of[self.end] if len(self.end) else self.end
        order = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            yield order[lo:hi]
