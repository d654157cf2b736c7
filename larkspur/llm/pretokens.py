"""Byte-level BPE by distinct pre-tokens, for vocabulary files of the ``tokenizers`` library.

A byte-level BPE never merges across pre-tokens, so the pieces of a text are the
pieces of its pre-tokens.  The pre-tokens of a block of texts are found with a
few numpy passes over the character classes of its bytes instead of a regular
expression per text, and every distinct pre-token is handed to the library once.

The splitting rules are those of the byte-level pre-tokeniser with its regular
expression (contractions, letters, numbers, other characters, each with one
leading space, and white space); ``tests/llm`` compares them with the library
for every code point and for random texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from larkspur.llm.textblock import Block, span_hashes, span_keys

OTHER, LETTER, NUMBER, SPACE, BORDER = range(5)


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def char_classes(path: str) -> np.ndarray:
    """The class of each code point.  Code points newer than Python's Unicode tables are asked of the library itself."""
    import unicodedata

    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[np.frombuffer(m[0].encode("utf-32-le"), "<u4")] = kind
    new = [c for c in np.flatnonzero(table).tolist() if unicodedata.category(chr(c)) == "Cn"]
    probe = "".join(f"\n!{chr(c)}!\na{chr(c)}\n1{chr(c)}" for c in new)
    starts = np.zeros(len(probe) + 1, bool)
    starts[[begin for _, (begin, _) in tokenizer(path).pre_tokenizer.pre_tokenize_str(probe)]] = True
    starts = starts[:-1].reshape(-1, 10)
    alone = starts[:, 2]  # not one pre-token with the "!" before it
    table[new] = np.select([~alone & ~starts[:, 3], ~starts[:, 6], ~starts[:, 9]], [OTHER, LETTER, NUMBER], SPACE)
    return table


def supported(path: str) -> list[tuple[str, int]]:
    """The special strings of the file and their ids; an error if the file is not plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError(f"{path}: only byte-level BPE files without normaliser and prefix space are supported")
    special = spec["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
        raise ValueError(f"{path}: added tokens with stripping or word rules aren't supported")
    return [(t["content"], t["id"]) for t in special]


class Pieces:
    """The distinct pre-tokens of some texts.

    ``segment``: the segment of each pre-token, in text order; a text is cut into
    segments at special strings.  ``which``: its index among the distinct ones, whose
    bytes ``distinct()`` gives.  ``first_segment[r]:first_segment[r + 1]`` are the
    segments of text r, ``special[s]`` the special id that follows segment s, or -1.
    """

    def __init__(self, texts: list[bytes], specials: list[tuple[str, int]], classes: np.ndarray):
        parts: list[bytes] = []
        self.special: list[int] = []
        self.first_segment = [0]
        marks = [(s.encode(), i) for s, i in specials]
        for text in texts:
            if any(m in text for m, _ in marks):
                for piece, i in _cut(text, marks):
                    parts.append(piece)
                    self.special.append(i)
            else:
                parts.append(text)
                self.special.append(-1)
            self.first_segment.append(len(parts))
        self.block = block = self._block(parts)
        self.start, self.length = _spans(block, classes)
        self.segment = np.searchsorted(block.ptr, self.start, side="right") - 1
        self.hash = span_hashes(block, self.start, self.length)
        _, self.at, self.which = np.unique(self.hash, return_index=True, return_inverse=True)
        self._verify()

    @staticmethod
    def _block(parts: list[bytes]) -> Block:
        block = Block(parts)
        try:
            block.text = block.data[: block.size].tobytes().decode()
        except UnicodeDecodeError:
            block = Block([p.decode("utf-8", "replace").encode() for p in parts])
            block.text = block.data[: block.size].tobytes().decode()
        return block

    def _verify(self) -> None:
        """Pre-tokens with one hash must have the same bytes; else give them hashes of their own."""
        first = self.at[self.which]
        k1, k2 = span_keys(self.block, self.start, np.minimum(self.length, 16))
        same = (self.length == self.length[first]) & (k1 == k1[first]) & (k2 == k2[first])
        for i in np.flatnonzero(same & (self.length > 16)).tolist():
            same[i] = self.bytes(i) == self.bytes(int(first[i]))
        if not same.all():  # a collision of 64-bit hashes
            ids: dict[bytes, int] = {}
            self.which = np.array([ids.setdefault(self.bytes(i), len(ids)) for i in range(len(self.start))])
            _, self.at = np.unique(self.which, return_index=True)

    def bytes(self, i: int) -> bytes:
        s = int(self.start[i])
        return self.block.data[s : s + int(self.length[i])].tobytes()

    def distinct(self) -> list[bytes]:
        raw, start, stop = self.block.data.tobytes(), self.start[self.at].tolist(), (self.start[self.at] + self.length[self.at]).tolist()
        return [raw[a:b] for a, b in zip(start, stop)]


def _cut(text: bytes, marks: list[tuple[bytes, int]]):
    """Leftmost special strings, the longest at a place first, as the library cuts them out."""
    at = 0
    while True:
        found = min(((p, -len(m), m, i) for m, i in marks if (p := text.find(m, at)) >= 0), default=None)
        if not found:
            yield text[at:], -1
            return
        yield text[at : found[0]], found[3]
        at = found[0] + len(found[2])


def _spans(block: Block, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = block.data
    n = block.size
    points = np.frombuffer(block.text.encode("utf-32-le"), "<u4")
    cls = classes[points]
    if len(points) != n:
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        cls = np.repeat(cls, wide)
    kind = np.full(n + 4, BORDER, np.uint8)
    kind[:n] = cls
    kind[block.ptr[1:] - 1] = BORDER
    start = np.ones(n + 4, bool)
    start[1:] = kind[1:] != kind[:-1]
    # the last character of a run of white space before something else
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
    plain = data[after - 1] == 0x20
    start[after[plain] - 1] = True
    start[after[plain]] = False
    odd = after[~plain] - 1
    for _ in range(3):
        odd = odd - ((data[odd] & 0xC0) == 0x80)
    start[odd] = True
    # contractions
    quote = np.flatnonzero((data[:n] == 0x27) & start[:n] & (kind[1 : n + 1] == LETTER))
    if len(quote):
        b1, b2 = data[quote + 1], data[quote + 2]
        two = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
        three = ((b1 == ord("r")) | (b1 == ord("v"))) & (b2 == ord("e")) | (b1 == ord("l")) & (b2 == ord("l"))
        three &= kind[quote + 2] == LETTER
        hit = two | three
        stop = quote[hit] + np.where(two[hit], 2, 3)
        start[quote[hit] + 1] = False
        start[stop[kind[stop] == LETTER]] = True
    at = np.flatnonzero(start[: n + 1])
    length = np.diff(np.append(at, n + 1))
    keep = kind[at] != BORDER
    return at[keep], length[keep]


class IdCache:
    """Token ids of pre-tokens, from the library; a bounded number of them is kept, back to back in one array."""

    def __init__(self, path: str, limit: int = 500_000):
        self.library, self.limit = tokenizer(path), limit
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each piece begin, and how many they are.  A later call may move them."""
        new = [p for p in pieces if p not in self.index]
        if len(self.index) + len(new) > self.limit:
            self._keep([p for p in pieces if p in self.index])
        if new:
            self._add(new, [e.ids for e in self.library.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)])
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return self.ends[at], self.ends[at + 1] - self.ends[at]

    def _add(self, pieces: list[bytes], ids: list[list[int]]) -> None:
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def _keep(self, pieces: list[bytes]) -> None:
        ids = [self.flat[self.ends[i] : self.ends[i + 1]].tolist() for i in map(self.index.__getitem__, pieces)]
        self.index, self.flat, self.ends = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._add(pieces, ids)


@lru_cache(2)
def id_cache(path: str) -> IdCache:
    """One for all tasks that a Python worker runs."""
    return IdCache(path)


def string_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary()).cast(pa.string())
