"""Vectorised text primitives shared by the Arrow-batched operators.

A :class:`Block` holds the UTF-8 bytes of some documents back to back, each
followed by one separator byte, so that no word crosses a document.  Words,
their hashes and their n-gram hashes are numpy arrays over the whole block, which
keeps Python out of the per-word path.  Blocks are cut by bytes, so the memory
used does not depend on the number of rows in an Arrow batch.

Hash equality is never taken for text equality where a result depends on it:
the callers compare the texts themselves, or 128 bits for whole documents.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
PAD = 16

#: Bytes that end a word: space and the ASCII controls 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that end a word where punctuation is ignored: all ASCII but letters and digits.
PUNCT = np.zeros(256, bool)
PUNCT[[i for i in range(128) if not chr(i).isalnum()]] = True

_C0, _C1, _C2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


class Block:
    """``data``: bytes with PAD spare bytes at the end; ``ptr[d]:ptr[d + 1] - 1`` is document d."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        raw = b"\n".join([*texts, b"\0" * PAD])
        self.data = np.frombuffer(raw, np.uint8)
        self.ptr = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1, out=self.ptr[1:])
        self.size = int(self.ptr[-1])
        self.u64 = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))


def text_bytes(column: pa.Array, lower: bool = False) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of the batches of at most ``limit`` text bytes, or of one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 1)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    release()


def release() -> None:
    """Give freed memory back, which a worker that is used again would keep beside what its next task needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


class Words:
    """Start, length and document of each word of a block; ``ptr[d]:ptr[d + 1]`` are those of document d."""

    def __init__(self, block: Block, separators: np.ndarray = WHITE):
        inside = np.empty(block.size + 1, np.int8)
        inside[0] = 0
        sep = separators[block.data[: block.size]]
        sep[block.ptr[1:] - 1] = True
        np.logical_not(sep, out=inside[1:].view(bool))
        step = np.diff(inside)
        self.block = block
        self.start = np.flatnonzero(step == 1)
        self.length = np.flatnonzero(step == -1) - self.start
        self.ptr = np.searchsorted(self.start, block.ptr)
        self.doc = np.repeat(np.arange(block.n), np.diff(self.ptr))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.block, self.start, self.length)


def span_hashes(block: Block, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes in any block."""
    h = mix(length.astype(np.uint64) * _C0)
    if not len(start):
        return h
    h = mix(h ^ (block.u64[start] & _MASKS[np.minimum(length, 8)]))
    rest, at = np.flatnonzero(length > 8), 8
    while len(rest) and at < 256:
        left = length[rest] - at
        h[rest] = mix(h[rest] ^ (block.u64[start[rest] + at] & _MASKS[np.minimum(left, 8)]))
        rest = rest[left > 8]
        at += 8
    raw = block.data
    for i in rest.tolist():
        whole = raw[start[i] : start[i] + length[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    return h


def span_keys(block: Block, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans of at most 16 bytes as two integers, exactly."""
    first = block.u64[start] & _MASKS[np.minimum(length, 8)]
    second = np.zeros(len(start), np.uint64)
    long = np.flatnonzero(length > 8)
    second[long] = block.u64[start[long] + 8] & _MASKS[np.minimum(length[long] - 8, 8)]
    return first, second


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes; document borders are not looked at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = mix(out ^ hashes[j : j + n]) * _C0
        return out
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_INVERSE, n))


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all k-word shingles; a shorter document that has words is one shingle."""
    runs = window_hashes(hashes, k)
    inside = words.doc[: len(runs)] == words.doc[k - 1 :] if len(runs) else np.zeros(0, bool)
    h, doc = runs[inside], words.doc[: len(runs)][inside]
    counts = np.diff(words.ptr)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k):
            at = words.ptr[short] + j
            have = at < words.ptr[short + 1]
            extra[have] = mix(extra[have] ^ hashes[at[have]]) * _C0
        h = np.concatenate([h, mix(extra + counts[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    return h, doc


def weighted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts, ordered by document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def document_keys(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the word sequences of the documents."""
    out = []
    local = np.arange(len(words)) - np.repeat(words.ptr[:-1], np.diff(words.ptr))
    for salt in (0x1234567, 0x89ABCDEF12345):
        # position-dependent terms; their sum over a document is order-sensitive
        term = mix(hashes ^ mix(local.astype(np.uint64) * _C0 + np.uint64(salt)))
        sums = np.zeros(len(term) + 1, np.uint64)
        np.cumsum(term, out=sums[1:])
        out.append(mix(sums[words.ptr[1:]] - sums[words.ptr[:-1]] + np.diff(words.ptr).astype(np.uint64)))
    return out[0], out[1]
