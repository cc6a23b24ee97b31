"""Array views of Arrow string batches.

Python workers get documents as Arrow batches.  The functions here cut a batch into blocks of
bounded bytes and describe words, lines and n-grams of a whole block as numpy arrays, so no
operator loops over words in Python.  A block holds whole documents; a document above the limit
is a block by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single document has more.
BLOCK_BYTES = 1 << 20
#: Rows of an Arrow batch; bounds a Python worker's memory together with BLOCK_BYTES.
BATCH_ROWS = 1000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_S33 = np.uint64(33)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_STEP, _UNSTEP)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread evenly."""
    x = x ^ (x >> _S33)
    x = x * _MIX[0]
    x ^= x >> _S33
    x *= _MIX[1]
    x ^= x >> _S33
    return x


class Block:
    """Bytes of some documents with their bounds (``offs`` has one entry more than documents)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1
        self._sums: dict[bool, np.ndarray] = {}

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + self.n)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over each document's bytes."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of true bytes that do not cross documents: starts, ends, document numbers."""
        n = len(inside)
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        starts = np.flatnonzero(after[:-1] & (~before[:-1] | cut[:-1])) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(before[1:] & (~after[1:] | cut[1:])) + 1 if n else np.zeros(0, np.int64)
        return starts, ends, self.doc_of(starts)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than space and \\t \\n \\v \\f \\r."""
        return self.spans(~SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts between line feeds, empty ones too: starts, ends, document numbers."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offs[:-1], feeds + 1])
        ends = np.concatenate([feeds, self.offs[1:]])
        doc = np.concatenate([np.arange(self.n), self.doc_of(feeds)])
        # a feed ends the part that holds it; parts in order pair the k-th start with the k-th end of a document
        a, b = np.lexsort((starts, doc)), np.lexsort((ends, np.concatenate([self.doc_of(feeds), np.arange(self.n)])))
        return starts[a], ends[b], doc[a]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges; equal content has equal hashes in every block."""
        if lower not in self._sums:
            up, _ = powers(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[LOWER[self.data] if lower else self.data] * up[:-1], out=sums[1:])
            self._sums[lower] = sums
        sums, down = self._sums[lower], powers(len(self.data) + 1)[1]
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[1])


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items of one document, and the index of the first item of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    x = np.zeros(len(at), np.uint64)
    for k in range(n):
        x = mix(x * _STEP + hashes[at + k] + np.uint64(k + 1))
    return x, at


def with_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal hashes of the same document only."""
    return mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * _STEP)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: items whose key occurs again, and items that are not the first with their key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    if len(s):
        same[1:-1] = s[1:] == s[:-1]
    again, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    again[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return again, later


def text_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of whole documents of at most limit bytes, or of one document."""
    data, offs = text_block(column)
    n, first = len(offs) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield Block(data[offs[first] : offs[last]], offs[first : last + 1] - offs[first], first)
        first = last


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)
