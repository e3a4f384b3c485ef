"""Vectorised word kernels over Arrow string columns.

Texts are handled as UTF-8 bytes in chunks of bounded size, so memory does not follow the
batch size.  A word is a maximal run of word bytes; which bytes are word bytes is given as a
table of 256 flags (for UTF-8, bytes from 0x80 are parts of non-ASCII code points).

Equal words of a chunk are found by their bytes (a dictionary), and each distinct word is hashed
by BLAKE2b, so no structure of a word can bring about a collision.  A run of words is hashed as a
tree: the hash of 2, 4, 8, ... words mixes those of its halves, and a run of any length joins
such parts in order.  Nothing in it is linear, and there is no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20

JOIN = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (murmur3)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what ``a`` and ``b`` are hashes of, in this order."""
    with np.errstate(over="ignore"):
        return mixed(a * JOIN + b)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(_lengths(column))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the system; else a worker that waits for its next task keeps the most that it has ever needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def by_chunk(of: Callable[[pa.RecordBatch], pa.RecordBatch], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: ``of`` each chunk, whose working memory is free before the next one's is taken and given back after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield of(part)
        give_back()

    return run


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(_offsets(column)) if len(column) else np.zeros(0, np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = _offsets(column) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of the texts of one chunk.

    start, end: byte range of each word in ``raw``; doc: its row; first: index of each row's
    first word (rows + 1 entries); term: number of each word among the distinct ones, which are
    ``terms``; hash: 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: bool = False, hashes: bool = True):
        raw, offsets = text_bytes(column)
        self.text = raw
        if lower:
            raw = LOWER[raw]
        self.raw, self.offsets, n = raw, offsets, len(offsets) - 1
        flag = is_word[raw]
        begins = flag.copy()
        begins[1:] &= ~flag[:-1]
        ends = flag.copy()
        ends[:-1] &= ~flag[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = flag[inner]
        ends[inner - 1] = flag[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self._trees: dict[int, list[np.ndarray]] = {}
        if hashes:
            at = np.concatenate([[0], np.cumsum(self.end - self.start)])
            packed = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(raw[flag])])
            coded = packed.dictionary_encode()
            self.terms = coded.dictionary
            self.term = coded.indices.to_numpy().astype(np.int64)
            digests = b"".join(blake2b(t, digest_size=16).digest() for t in self.terms.to_pylist())
            self._halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            self.hash = self._halves[self.term, 0]

    def _tree(self, top: int, half: int) -> list[np.ndarray]:
        """Hashes of the 1, 2, 4, ... 2**top words from each word on (less words: no meaning)."""
        levels = self._trees.setdefault(half, [self._halves[self.term, half]])
        while len(levels) <= top:
            below, step = levels[-1], 1 << (len(levels) - 1)
            far = np.zeros_like(below)
            far[:-step] = below[step:]
            levels.append(joined(below, far))
        return levels

    def grams(self, k: int, half: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one row."""
        n = len(self.start)
        inside, out = np.zeros(n, bool), np.zeros(n, np.uint64)
        if n >= k:
            at = np.arange(n - k + 1)
            inside[: n - k + 1] = self.doc[at] == self.doc[k - 1 :]
            out[: n - k + 1] = self.span_hash(at, at + k, half)
        return out, inside

    def span_hash(self, start: np.ndarray, end: np.ndarray, half: int = 0) -> np.ndarray:
        """Hash of the words start..end (exclusive) for each pair; ``half`` 0 and 1 are independent."""
        length = end - start
        out = mixed(length.astype(np.uint64) ^ JOIN)
        if not len(length):
            return out
        top = int(length.max(initial=1)).bit_length() - 1
        levels, at = self._tree(top, half), start.astype(np.int64)
        for j in range(top, -1, -1):
            has = np.flatnonzero(length >> j & 1)
            out[has] = joined(out[has], levels[j][at[has]])
            at[has] += 1 << j
        return out


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of 0..n-1 that lie in any of the ranges start..end (exclusive)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:n] > 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sliding_min_at(values: np.ndarray, width: int, left: np.ndarray) -> np.ndarray:
    """Rising indices of the leftmost least value among ``width`` values from each ``left`` on."""
    if not len(left):
        return np.zeros(0, np.int64)
    n = len(values)
    at = np.arange(n)
    # doubling: the leftmost least index of 1, 2, 4, ... values, then two overlapping runs
    run = 1
    while run * 2 <= width:
        far = np.minimum(np.arange(n) + run, n - 1)
        at = np.where(values[at[far]] < values[at], at[far], at)
        run *= 2
    a, b = at[left], at[left + width - run]
    best = np.where(values[b] < values[a], b, a)
    return np.unique(best)
