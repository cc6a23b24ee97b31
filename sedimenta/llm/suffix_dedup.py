"""Removal of repeated byte strings by a distributed suffix sort.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts earlier (smaller
document, or earlier in the same one) is removed; strings are judged on the input.

* Of equal texts, only one takes part; the others are removed whole if they are long enough.
* Each window of LENGTH bytes is anchored at its least-hashed K-gram, so equal windows have equal
  anchors.  Consecutive windows of one anchor form a segment: the suffix that starts at the anchor
  and the bytes left of it.  Only segments whose K-gram occurs again go on.  A task folds the
  anchors that it meets, so a K-gram that a third of all documents hold is a few rows for each task.
* Splitters sampled from the suffixes (leading bytes, then what follows, the left bytes and the
  place) deal segments into buckets.  A splitter falls between groups of equal leading bytes, but
  for groups above the size of a bucket, which it cuts.  Buckets sort locally by multikey quicksort
  on 8-byte characters; a segment equal to its predecessor is a repeat, and the first of a bucket is
  compared to the last of the bucket before.
* Segments that are the first of their content may still share windows with others of the same
  K-gram.  Two share one only if their suffixes and their left bytes agree on LENGTH bytes together,
  so what each shares at most with its neighbours in both sorted orders leaves few windows to
  compare.  Groups that a splitter cuts compare theirs by 128-bit digests over a shuffle instead.

Null and empty texts have no byte.  Rows that repeat a document (same id, same text) are one
document and get the same result; rows with a null id come after all others.  Texts are told apart
by 128 bits of digests (text_id and its check).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.blocks import Block, blocks, mix, with_doc
from sedimenta.llm.tables import Scratch, bitmap, marked

#: Bytes of a string that counts as repeated, bytes of an anchor, and places that an anchor is chosen from.
LENGTH, K = 100, 40
PLACES = LENGTH - K + 1
#: Anchors that a task folds at once.
FOLD = 1_000_000
#: Segments of a bucket, about, buckets at most (beyond that they grow), and sampled segments for each.
BUCKET, BUCKETS, SAMPLED = 60_000, 1 << 16, 64
#: Windows that a bucket sorts at once.
WINDOWS = 200_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 20_000

_I = np.int64
_U = np.uint64
_LAST = (1 << 63) - 1
#: Kinds of rows that buckets return.
SPAN, WINDOW, HEAD, TAIL = range(4)
FOUND = "kind int, part int, text_id long, check long, id long, a long, z long, d1 long, d2 long"


def anchors(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a block: anchor, first and last window start (places in the block), document."""
    n = len(b.data)
    z = np.zeros(0, _I)
    if n < LENGTH:
        return z, z, z, z
    at = np.arange(n - K + 1)
    key = (b.hashes(at, at + K) & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    width = 1
    while 2 * width <= PLACES:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < PLACES:
        key = np.minimum(key[: len(key) - (PLACES - width)], key[PLACES - width :])
    size = np.maximum(np.diff(b.offs) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(b.n), size)
    start = np.arange(len(doc)) + np.repeat(b.offs[:-1] - (np.cumsum(size) - size), size)
    if not len(start):
        return z, z, z, z
    anchor = (key[start] & _U(0xFFFFFFFF)).astype(_I)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], start[first], start[last], doc[first]


def _grams(b: Block, a: np.ndarray) -> np.ndarray:
    """Hashes of the K-grams at a; the two lowest bits are left free for a mark."""
    return (b.hashes(a, a + K) & ~_U(3)).view(_I)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte characters: three-way partitions on one character, equal parts go on with the next."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    width = words.shape[1]
    while stack:
        a, z, depth = stack.pop()
        if z - a < 2 or depth == width:
            continue
        rows = order[a:z]
        if z - a <= 2048:
            order[a:z] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        c = words[rows, depth]
        some = c[:: max(1, len(c) // 255)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        low, high = c < pivot, c > pivot
        equal = ~(low | high)
        order[a:z] = np.concatenate([rows[low], rows[equal], rows[high]])
        i, j = a + int(low.sum()), z - int(high.sum())
        stack += [(a, i, depth), (i, j, depth + 1), (j, z, depth)]
    return order


def _characters(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes (a multiple of 8) as big-endian 8-byte characters."""
    return np.ascontiguousarray(rows).view(">u8").astype(_U)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """A binary column as rows of width bytes, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(_I) if n else np.zeros(1, _I)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(1, np.uint8)
    return _windows_at(data, offs[:-1], np.diff(offs), width)


def _windows_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of width bytes from each start, zero beyond its size."""
    room = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(room, width)[starts]
    out[np.arange(width)[None, :] >= sizes[:, None]] = 0
    return out


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offs = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data[at].tobytes())])


def sort_keys(suffix: np.ndarray, n_suffix: np.ndarray, left: np.ndarray, n_left: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings in the order of segments; suffix and left are zero-filled rows, place whole numbers."""
    number = [np.ascontiguousarray((x ^ _I(-(1 << 63))).astype(">i8")).view(np.uint8).reshape(-1, 8) for x in place]
    end = np.ones((len(suffix), 1), np.uint8)  # numpy drops zeros at the end
    size = lambda n: n.astype(np.uint8)[:, None]
    rows = np.ascontiguousarray(np.concatenate([suffix[:, :LENGTH], size(n_suffix), left[:, : LENGTH - K], size(n_left), *number, end], 1))
    return rows.view(f"S{rows.shape[1]}").ravel()


def leads(suffix: np.ndarray) -> np.ndarray:
    """The leading K bytes of zero-filled rows, as byte strings that keep their zeros."""
    rows = np.ascontiguousarray(np.concatenate([suffix[:, :K], np.ones((len(suffix), 1), np.uint8)], 1))
    return rows.view(f"S{K + 1}").ravel()


def splitters(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """At most buckets - 1 splitters from sampled keys, and the leads that they cut (sorted).

    A splitter is put where its group of equal leads begins, unless the group is larger than a bucket.
    """
    keys = np.sort(keys)
    if buckets < 2 or not len(keys):
        return keys[:0], np.zeros(0, f"S{K + 1}")
    width = keys.dtype.itemsize
    raw = keys.view(np.uint8).reshape(len(keys), width)
    lead = leads(raw)
    at = np.unique(np.arange(1, buckets) * len(keys) // buckets)
    first, last = np.searchsorted(lead, lead[at]), np.searchsorted(lead, lead[at], "right")
    large = last - first > max(2, len(keys) / buckets)
    out = raw[at].copy()
    out[~large, K : width - 1] = 0
    return np.unique(np.ascontiguousarray(out).view(keys.dtype).ravel()), np.unique(lead[at[large]])


def _unseen(ids: np.ndarray, checks: np.ndarray, seen: set) -> np.ndarray:
    """Texts that the task meets first."""
    new = np.zeros(len(ids), bool)
    for k, x in enumerate(zip(ids.tolist(), checks.tolist(), strict=True)):
        if x not in seen:
            seen.add(x)
            new[k] = True
    return new


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_id, check, text to the K-grams of each text: x, the gram's hash with a mark, and text_id.

    Mark 0: met once; 1: met again in this task, so known to be repeated; 2: the one of those that
    tells the other tasks.
    """
    seen: set = set()
    held: list[np.ndarray] = []

    def folded() -> Iterator[pa.RecordBatch]:
        h, t = np.concatenate(held, axis=1)
        held.clear()
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        new, pair = np.ones(len(h), bool), np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        pair[1:] = new[1:] | (t[1:] != t[:-1])
        group = np.cumsum(new) - 1
        mark = np.where(np.bincount(group)[group] > 1, np.where(new, 2, 1), 0)
        x, t = (h | mark)[pair], t[pair]
        for k in range(0, len(x), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + OUT_ROWS]), pa.array(t[k : k + OUT_ROWS])], ["x", "text_id"])

    for batch in batches:
        ids, checks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for b in blocks(batch.column(2)):
            new = _unseen(ids[b.rows], checks[b.rows], seen)
            a, _, _, d = anchors(b)
            a, d = a[new[d]], d[new[d]]
            held.append(np.stack([_grams(b, a), ids[b.rows][d]]))
            if sum(x.shape[1] for x in held) > FOLD:
                yield from folded()
    if held:
        yield from folded()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked grams, sorted, to text_id and h of those that occur again."""
    known = None  # a hash that has been seen to repeat, while its rows go on
    rest = np.zeros((2, 0), _I)  # one row whose next may be in the next batch

    def out(t: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(h)], ["text_id", "h"])

    for batch in batches:
        x, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        through = (x & 3) == 1
        yield out(t[through], x[through] & ~3)
        x, t = np.concatenate([rest, np.stack([x, t])[:, ~through]], axis=1)
        if not len(x):
            continue
        h, sure = x & ~3, (x & 3) == 2
        new, pair = np.ones(len(h), bool), np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        pair[1:] = new[1:] | (t[1:] != t[:-1])
        group = np.cumsum(new) - 1
        hit = (np.bincount(group, pair)[group] > 1) | (np.bincount(group, sure)[group] > 0)
        if known is not None:
            hit |= h == known
        known, rest = (h[-1], rest[:, :0]) if hit[-1] else (None, np.stack([x[-1:], t[-1:]]))
        hit &= pair
        yield out(t[hit], h[hit])


def _segments(cuts, sampled: bool = False):
    """text_id, check, id, text, hashes to segments with their bucket, or to sampled segments.

    Segments equal to an earlier one of the block come as intervals: place and id are their bounds,
    suffix is null.
    """
    names = ["bucket", "text_id", "check", "id", "place", "suffix", "left"]

    def rows(b: Block, ids: np.ndarray, checks: np.ndarray, ident: np.ndarray, hashes: pa.Array, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, lo, hi, d = anchors(b)
        of = np.repeat(np.arange(b.n), pa.compute.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(_I))
        wanted = with_doc(hashes.flatten().to_numpy().view(_U), of)
        use = np.flatnonzero(new[d])
        use = use[np.isin(with_doc(_grams(b, a[use]).view(_U), d[use]), wanted)]
        a, lo, hi, d = a[use], lo[use], hi[use], d[use]
        by = np.lexsort((a, ids[d], ident[d]))
        a, lo, hi, d = a[by], lo[by], hi[by], d[by]
        end = hi + LENGTH
        key = np.stack([b.hashes(lo, end), b.hashes(a, end), (a - lo).astype(_U)])
        back = np.lexsort(key)  # stable: the earliest of equal segments stays first
        dup = np.zeros(len(a), bool)
        dup[back[1:]] = (key[:, back[1:]] == key[:, back[:-1]]).all(0)
        if dup.any() and not sampled:
            doc, u, v = _merged(d[dup], lo[dup], end[dup])
            o = b.offs[doc]
            none = pa.nulls(len(doc), pa.binary())
            where = (mix(ids[doc].view(_U)) % _U(len(cuts.value[0]) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(ids[doc]), pa.array(checks[doc]), pa.array(v - o), pa.array(u - o), none, none], names)
        a, lo, end, d = a[~dup], lo[~dup], end[~dup], d[~dup]
        bucket = np.zeros(len(a), np.int32)
        if not sampled and len(cuts.value[0]) and len(a):
            keys = sort_keys(_windows_at(b.data, a, end - a, LENGTH), end - a, _windows_at(b.data, lo, a - lo, LENGTH - K), a - lo, ident[d], ids[d], a - b.offs[d])
            bucket = np.searchsorted(cuts.value[0], keys, "right").astype(np.int32)
        if sampled:
            few = (mix(ids[d].view(_U) + a.astype(_U) * _U(0x9E3779B97F4A7C15)) & _U(7)) == 0 if sampled == "few" else np.ones(len(a), bool)
            a, lo, end, d, bucket = a[few], lo[few], end[few], d[few], bucket[few]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids[d]), pa.array(checks[d]), pa.array(ident[d]), pa.array(a - b.offs[d]), _binary(b.data, a, end), _binary(b.data, lo, a)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids, checks, ident = (batch.column(k).to_numpy() for k in range(3))
            for b in blocks(batch.column(3)):
                for out in rows(b, ids[b.rows], checks[b.rows], ident[b.rows], batch.column(4)[b.rows], _unseen(ids[b.rows], checks[b.rows], seen)):
                    for k in range(0, out.num_rows, OUT_ROWS):
                        yield out.slice(k, OUT_ROWS)

    return run


def _merged(text: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of texts (small numbers), those that touch or overlap made one."""
    by = np.lexsort((a, text))
    text, a, z = text[by], a[by], z[by]
    if not len(a):
        return text, a, z
    # texts are put one behind the other, so that one running maximum serves all
    shift = text * (int(z.max()) + 2)
    top = np.maximum.accumulate(z + shift)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + shift[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return text[first], a[first], top[last] - shift[first]


def _shared(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Leading bytes that each row (sorted, zero-filled) has in common with the next."""
    out = np.zeros(max(0, len(rows) - 1), _I)
    for k in range(0, len(out), 50_000):
        part = rows[k : k + 50_001]
        other = part[1:] != part[:-1]
        first = np.where(other.any(1), other.argmax(1), rows.shape[1])
        out[k : k + 50_000] = np.minimum(first, np.minimum(size[k : k + 50_001][1:], size[k : k + 50_001][:-1]))
    return out


def _neighbours(common: np.ndarray, n: int) -> np.ndarray:
    """The larger of what each row shares with the one before and the one after."""
    out = np.zeros(n, _I)
    out[:-1] = common
    out[1:] = np.maximum(out[1:], common)
    return out


def _buckets(hot: np.ndarray):
    """Segments sorted by bucket to FOUND rows: repeated intervals, windows of cut groups, and the ends of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        last = None  # content and row of the last segment so far

        def process() -> Iterator[pa.RecordBatch]:
            nonlocal last
            t = pa.Table.from_batches(held)
            held.clear()
            whole = pa.compute.is_null(t.column("suffix"))
            given = t.filter(whole)
            text_id, check, z, a = (given.column(c).to_numpy() for c in ("text_id", "check", "id", "place"))
            yield from _found(SPAN, part, text_id, check, a, z)
            t = t.filter(pa.compute.invert(whole))
            if t.num_rows:
                last, rows = yield from _bucket(t, part, last, hot)
                tail[:] = rows

        tail: list = []
        now = None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for s, e in zip(cut, cut[1:], strict=False):
                if s == e:
                    continue
                if now is not None and bucket[s] != now:
                    yield from process()
                now = bucket[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from process()
        yield from tail

    return run


def _found(kind: int, part: int, text_id: np.ndarray, check: np.ndarray, a: np.ndarray, z: np.ndarray, ident: np.ndarray | None = None, d1: np.ndarray | None = None, d2: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    n = len(text_id)
    none = np.zeros(n, _I)
    cols = [np.full(n, kind, np.int32), np.full(n, part, np.int32), text_id, check, none if ident is None else ident, a, z, none if d1 is None else d1, none if d2 is None else d2]
    names = [x.split(" ")[0] for x in FOUND.split(", ")]
    for k in range(0, n, OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + OUT_ROWS]) for c in cols], names)


def _digests(seg: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows that begin at starts in rows of seg (rows ascend); a block of rows at a time."""
    one, two = np.zeros((2, len(rows)), _U)
    half, width, step = LENGTH // 2, seg.shape[1], 4096
    for k in range(0, len(seg), step):
        s, e = np.searchsorted(rows, [k, k + step])
        if s < e:
            part = seg[k : k + step]
            block = Block(part.reshape(-1), np.array([0, part.size]), 0)
            at = (rows[s:e] - k) * width + starts[s:e]
            one[s:e] = block.hashes(at, at + LENGTH)
            two[s:e] = mix(block.hashes(at, at + half) * _U(0xD6E8FEB86659FD93) + block.hashes(at + half, at + LENGTH))
    return one.view(_I), two.view(_I)


def _bucket(t: pa.Table, part: int, last, hot: np.ndarray):
    suffix, left = t.column("suffix").combine_chunks(), t.column("left").combine_chunks()
    size, depth = (pa.compute.binary_length(x).to_numpy(zero_copy_only=False).astype(_I) for x in (suffix, left))
    rows = _padded(suffix, 104)
    text_id, check, ident, place = (t.column(c).to_numpy() for c in ("text_id", "check", "id", "place"))
    sign = lambda x: (x ^ _I(-(1 << 63))).view(_U)[:, None]
    words = np.concatenate([_characters(rows), size[:, None].astype(_U), _characters(_padded(left, 64)), depth[:, None].astype(_U), sign(ident), sign(text_id), sign(place)], 1)
    order = multikey_quicksort(words)
    content = words[order, :-3]
    dup = np.zeros(len(order), bool)
    dup[1:] = (content[1:] == content[:-1]).all(1)
    lo, end = place - depth, place + size
    both = pa.compute.binary_join_element_wise(left, suffix, pa.scalar(b"", pa.binary()))
    seg = _padded(both, 168)

    def mark(kind: int, k: int) -> list[pa.RecordBatch]:
        """The row of a segment at an end of the partition, with a digest of its content."""
        bytes_ = np.concatenate([seg[k], [size[k], depth[k]]]).astype(np.uint8)
        own, n = Block(bytes_, np.array([0, len(bytes_)]), 0), np.array([len(bytes_)])
        d1 = own.hashes(n * 0, n)
        d2 = mix(own.hashes(n * 0, n // 2) * _U(0xD6E8FEB86659FD93) + own.hashes(n // 2, n))
        pick = slice(k, k + 1)
        return list(_found(kind, part, text_id[pick], check[pick], lo[pick], end[pick], ident[pick], d1.view(_I), d2.view(_I)))

    if last is None:
        yield from mark(HEAD, int(order[0]))
    else:
        dup[0] = bool((content[0] == last).all())
    gone = order[dup]
    yield from _found(SPAN, part, text_id[gone], check[gone], lo[gone], end[gone])

    heads = order[~dup]
    if len(heads):
        lead = leads(rows[heads])
        common = _shared(rows[heads], size[heads])
        common[lead[1:] != lead[:-1]] = 0
        right = _neighbours(common, len(heads))
        cut = np.isin(lead, hot) if len(hot) else np.zeros(len(heads), bool)
        if cut.any():
            at = np.flatnonzero(cut)
            # what lies beyond the bucket is unknown: its outermost segments compare all their windows
            right[at[[0, -1]]] = LENGTH
            k, first, count = _range(heads[at], right[at], depth[heads[at]], size, depth)
            if len(k):
                by = np.argsort(k, kind="stable")
                row, start = np.repeat(k[by], count[by]), np.repeat(first[by] - (np.cumsum(count[by]) - count[by]), count[by])
                start += np.arange(len(row))
                d1, d2 = _digests(seg, row, start)
                yield from _found(WINDOW, part, text_id[row], check[row], lo[row] + start, lo[row] + start + LENGTH, ident[row], d1, d2)
        # the left side of the others, from the anchor outwards
        use = np.flatnonzero(~cut & (right + depth[heads] >= LENGTH))
        if len(use):
            group = np.unique(lead[use], return_inverse=True)[1]
            own = heads[use]
            back = np.arange(64)[None, :]
            inside = back < depth[own][:, None]
            reverse = np.where(inside, seg[own[:, None], np.where(inside, depth[own][:, None] - 1 - back, 0)], 0).astype(np.uint8)
            by = np.lexsort((*_characters(reverse).T[::-1], group))
            common = _shared(reverse[by], depth[own[by]])
            common[np.diff(group[by]) != 0] = 0
            reach = np.zeros(len(own), _I)
            reach[by] = _neighbours(common, len(own))
            keep = (reach + right[use] >= LENGTH) & (np.bincount(group)[group] > 1)
            k, first, count = _range(own[keep], right[use][keep], reach[keep], size, depth)
            if len(k):
                group = np.unique(leads(rows[k]), return_inverse=True)[1]
                by = np.argsort(group, kind="stable")
                yield from _repeats(seg, k[by], first[by], count[by], group[by], depth, part, text_id, check, ident, lo)
    return content[-1], mark(TAIL, int(order[-1]))


def _range(rows: np.ndarray, right: np.ndarray, reach: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments with the windows to compare: the first, and how many; right and reach: bytes shared right and left of the anchor."""
    least = np.maximum(LENGTH - np.minimum(right, size[rows]), 0)  # bytes left of the anchor
    most = np.minimum(reach, depth[rows])
    use = least <= most
    rows, least, most = rows[use], least[use], most[use]
    return rows, depth[rows] - most, most - least + 1


def _parts(group: np.ndarray, count: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows (segment, number of the window in it) in parts of about WINDOWS that keep equal ones together.

    Segments of a group stay together; a larger group is parted by the bytes left of the anchor,
    which equal windows share.  offset has those of each segment's first window.
    """
    before = np.cumsum(count) - count
    a, n = 0, len(group)
    while a < n:
        z = min(n, max(a + 1, int(np.searchsorted(before, before[a] + WINDOWS))))
        if z < n:
            start = int(np.searchsorted(group, group[z]))
            z = start if start > a else int(np.searchsorted(group, group[a], "right"))
        k = np.repeat(np.arange(a, z), count[a:z])
        s = np.arange(len(k)) - np.repeat(before[a:z] - before[a], count[a:z])
        if len(k) <= 2 * WINDOWS:
            yield k, s
        else:
            left = offset[k] - s
            by = np.argsort(left, kind="stable")
            k, s, left = k[by], s[by], left[by]
            cut = np.flatnonzero(np.diff(left)) + 1
            last = 0
            for c in [*cut.tolist(), len(k)]:
                if c - last >= WINDOWS or c == len(k):
                    yield k[last:c], s[last:c]
                    last = c
        a = z


def _repeats(seg: np.ndarray, rows: np.ndarray, first: np.ndarray, count: np.ndarray, group: np.ndarray, depth: np.ndarray, part: int, text_id: np.ndarray, check: np.ndarray, ident: np.ndarray, lo: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows (count of them from first, in each of rows) that equal an earlier window of the same group, as intervals."""
    flat = np.lib.stride_tricks.sliding_window_view(np.concatenate([seg.reshape(-1), np.zeros(LENGTH, np.uint8)]), LENGTH)
    for k, s in _parts(group, count, depth[rows] - first):
        r, s = rows[k], first[k] + s
        at = lo[r] + s
        window = np.zeros((len(r), 104), np.uint8)
        window[:, :LENGTH] = flat[r * seg.shape[1] + s]
        words = _characters(window)
        order = multikey_quicksort(words)
        same = np.zeros(len(order), bool)
        same[1:] = (words[order[1:]] == words[order[:-1]]).all(1)
        number = np.zeros(len(order), _I)
        number[order] = np.cumsum(~same)
        by = np.lexsort((at, check[r], text_id[r], ident[r], number))
        later = by[1:][number[by[1:]] == number[by[:-1]]]
        if len(later):
            of, own = np.unique(np.stack([text_id[r[later]], check[r[later]]]), axis=1, return_inverse=True)
            t, a, z = _merged(own.ravel(), at[later], at[later] + LENGTH)
            yield from _found(SPAN, part, of[0][t], of[1][t], a, z)


def _once(bits):
    """text_id, check, text rows whose bit is set, each text once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids, checks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            some = np.flatnonzero(marked(bits.value, ids))
            some = some[_unseen(ids[some], checks[some], seen)]
            if len(some):
                yield batch.take(pa.array(some))

    return run


def _digest(text: str = "text") -> list:
    """Two independent 64-bit digests of a text; null counts as empty."""
    text = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(text, F.octet_length(text)).alias("text_id"), F.xxhash64(F.lit(7919), text).alias("check")]


def _own(doc_id: str = "doc_id"):
    """A document's place among all: its id, null last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))


def repeats(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(firsts: text_id, check, id of the first document; spans: text_id, check, spans array of (a, z) removed in it), distinct texts only."""
    spark = docs.sparkSession
    every = docs.select(_own().alias("id"), "text", *_digest())
    firsts = scratch.write(every.groupBy("text_id", "check").agg(F.min("id").alias("id")), "firsts")
    texts = firsts.count()
    long = every.where(F.octet_length("text") >= LENGTH).select("text_id", "check", "text")

    x = F.col("x")
    marks = long.mapInArrow(_anchored, "x long, text_id long").repartition(F.when(x.bitwiseAND(F.lit(3)) == 1, F.col("text_id")).otherwise(F.shiftright(x, 2)))
    again = scratch.write(marks.sortWithinPartitions("x", "text_id").mapInArrow(_again, "text_id long, h long"), "again")
    rows = again.count()
    scratch.drop()

    def found(again: DataFrame, texts: DataFrame) -> DataFrame:
        hashes = again.groupBy("text_id").agg(F.collect_list("h").alias("hashes"))
        named = firsts.select("text_id", F.col("check").alias("first_check"), "id")
        # dealt here, not by the join: all rows of a text must meet in one task, which drops its copies
        return texts.repartition("text_id").join(hashes, "text_id").join(named, "text_id").where("check = first_check").select("text_id", "check", "id", "text", "hashes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(BUCKETS, max(parts, rows // BUCKET))
    row = "bucket int, text_id long, check long, id long, place long, suffix binary, left binary"
    share = 8 * SAMPLED * buckets / max(1, rows)
    chosen = F.pmod(F.xxhash64(F.lit(31), "text_id"), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * share))
    seen = found(again.where(chosen), long.where(chosen)).mapInArrow(_segments(None, "few" if share < 1 else "all"), row).where("suffix is not null").drop("bucket").toArrow()
    n = lambda c: pa.compute.binary_length(seen.column(c)).to_numpy().astype(_I)
    keys = sort_keys(_padded(seen.column("suffix"), LENGTH), n("suffix"), _padded(seen.column("left"), LENGTH - K), n("left"), *(seen.column(c).to_numpy() for c in ("id", "text_id", "place")))
    cuts = spark.sparkContext.broadcast(splitters(keys, buckets))  # at most BUCKETS keys

    bits = spark.sparkContext.broadcast(bitmap(again.select(F.col("text_id").alias("point")), texts))
    every_segment = found(again, long.mapInArrow(_once(bits), "text_id long, check long, text string")).mapInArrow(_segments(cuts), row)
    dealt = every_segment.repartitionById(parts, F.floor(F.col("bucket") * F.lit(parts) / F.lit(len(cuts.value[0]) + 1)).cast("int"))
    got = scratch.write(dealt.sortWithinPartitions("bucket").mapInArrow(_buckets(cuts.value[1]), FOUND), "found")
    scratch.drop("again")

    ends = got.where(F.col("kind").isin(HEAD, TAIL)).orderBy("part").collect()  # two rows for each partition
    first, last = ({r["part"]: r for r in ends if r["kind"] == kind} for kind in (HEAD, TAIL))
    line = sorted(first)
    goes_on = [first[b] for a, b in zip(line, line[1:], strict=False) if (last[a]["d1"], last[a]["d2"]) == (first[b]["d1"], first[b]["d2"])]
    span = ["text_id", "check", "a", "z"]
    spans = got.where(F.col("kind") == SPAN).select(*span)
    if goes_on:
        spans = spans.union(spark.createDataFrame([tuple(r[c] for c in span) for r in goes_on], "text_id long, check long, a long, z long"))
    if len(cuts.value[1]):
        place = F.struct("id", "text_id", "check", "a")
        windows = got.where(F.col("kind") == WINDOW).select("d1", "d2", place.alias("place"), "z")
        least = windows.groupBy("d1", "d2").agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.union(windows.join(least, ["d1", "d2"]).where("place <> least").select("place.text_id", "place.check", "place.a", "z"))
    spans = scratch.write(spans.groupBy("text_id", "check").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")
    scratch.drop("found")
    return firsts, spans


def _covered(b: Block, spans: pa.Array) -> np.ndarray:
    """Which bytes of a block lie in its documents' spans."""
    flat = spans.flatten()
    n = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(_I)
    start = np.repeat(b.offs[:-1], n)
    step = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(step, start + flat.field("a").to_numpy(), 1)
    np.add.at(step, start + flat.field("z").to_numpy(), -1)
    return np.cumsum(step[:-1]) > 0


def _left(b: Block, gone: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bounds and bytes of what is left of a block's documents."""
    offs = np.zeros(b.n + 1, _I)
    np.cumsum(b.per_doc(~gone), out=offs[1:])
    return offs, b.data[~gone].tobytes()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_id, check, text, spans to the counts and the bytes that are left."""
    for batch in batches:
        for b in blocks(batch.column(2)):
            gone = _covered(b, batch.column(3)[b.rows])
            runs = np.bincount(b.spans(gone)[2], minlength=b.n)
            offs, data = _left(b, gone)
            left = pa.Array.from_buffers(pa.large_binary(), b.n, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[b.rows], batch.column(1)[b.rows], pa.array(b.per_doc(gone)), pa.array(runs), left], ["text_id", "check", "removed", "runs", "left"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    firsts, spans = repeats(docs, scratch)
    every = docs.select("doc_id", "text", *_digest())
    bits = spark.sparkContext.broadcast(bitmap(spans.select(F.col("text_id").alias("point")), spans.count()))
    long = every.where(F.octet_length("text") >= LENGTH).select("text_id", "check", "text")
    texts = long.mapInArrow(_once(bits), "text_id long, check long, text string").dropDuplicates(["text_id", "check"])
    cut = texts.join(spans, ["text_id", "check"]).mapInArrow(_cut, "text_id long, check long, removed long, runs long, left binary")
    cut = scratch.write(cut.select("text_id", "check", "removed", "runs", F.sha2("left", 256).alias("sha")), "cut")
    known = scratch.write(firsts.join(cut, ["text_id", "check"], "left"), "known")
    scratch.drop("firsts", "spans", "cut")
    text = F.coalesce("text", F.lit(""))
    own = every.select("doc_id", "text_id", "check", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = own.join(known, ["text_id", "check"])
    copy = (_own() != F.col("id")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).alias("n_removed"), pick(F.lit(1), F.col("runs"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("sha"), F.col("whole")).alias("kept_sha256"),
    )


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, spans to the row and its text without the characters that lose a byte."""
    for batch in batches:
        for b in blocks(batch.column(1)):
            gone = _covered(b, batch.column(2)[b.rows])
            letter = np.cumsum((b.data & 0xC0) != 0x80) - 1
            gone = np.bincount(letter, gone, minlength=1)[letter] > 0 if len(letter) else gone
            offs, data = _left(b, gone)
            text = pa.Array.from_buffers(pa.large_string(), b.n, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)]).cast(pa.string())
            text = pa.compute.if_else(pa.compute.is_null(batch.column(1)[b.rows]), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([batch.column(0)[b.rows], text], ["row", "cut"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, their texts without the removed bytes; rows left without text go.

    A character that loses some of its bytes goes whole.  n_chars follows the text.  Rows whose
    text was null or empty before stay.  Columns may have any names: rows travel whole in one column.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    firsts, spans = repeats(docs, scratch)
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _own().alias("own"), "text", *_digest())
    # a copy goes; the first of its text is shortened
    copies = every.where(F.octet_length("text") >= LENGTH).join(firsts, ["text_id", "check"]).where("own <> id").select("text_id", "check").distinct()
    copies = scratch.write(copies, "copies")
    touched = spans.select("text_id").union(copies.select("text_id"))
    bits = spark.sparkContext.broadcast(bitmap(touched.select(F.col("text_id").alias("point")), touched.count()))
    kind = T.StructType([T.StructField("row", docs.schema), *every.schema.fields[1:]])
    at = every.columns.index("text_id")

    def where(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marked(bits.value, batch.column(at).to_numpy()) == wanted))

        return run

    same = every.mapInArrow(where(False), kind).select("row.*")
    cut = firsts.join(spans, ["text_id", "check"], "left")
    joined = every.mapInArrow(where(True), kind).join(cut, ["text_id", "check"])
    copy = F.coalesce((F.octet_length("text") >= LENGTH) & (F.col("own") != F.col("id")), F.lit(False))  # a null text is no copy
    shorter = joined.where(~copy).select("row", "text", "spans").mapInArrow(_shorten, T.StructType([kind["row"], T.StructField("cut", T.StringType())]))
    shorter = shorter.where((F.coalesce(F.col("row.text"), F.lit("")) == "") | (F.col("cut") != ""))
    out = same.union(shorter.select(F.col("row").withField("text", F.col("cut")).alias("row")).select("row.*"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
