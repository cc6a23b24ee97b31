"""Exact Jaccard similarity join of word shingles in metric space.

The distance 1 - |x & y| / |x | y| of finite sets is a metric.  Documents with equal sets are one
point.  Regions are formed in two levels:

* One-shingle sets are pivots.  A set is nearest to the pivots it contains (1 - 1/|x|); ties go by
  a global order, rare shingles first.  Two points within the radius share a pivot among the first
  |x| - ceil(t|x|) + 1 of their orders, so a point is replicated to these regions and no pair is
  lost.  Document pivots alone cannot form first regions: nearly all documents are at distance 1
  from any other, so their triangle-inequality windows hold everything.
* A small region yields its pairs, after size and position bounds and a lower bound on the
  symmetric difference (parity sketches).  A large region hands its points to its least point, a
  document pivot; all points handed to one pivot form a cell, which holds every pair of the
  regions behind it.  All points of a cell are measured against its pivot.  Those within the radius
  are linked, and so need no comparison with each other; what is left are the far points, and the
  near ones that by the triangle inequality may be within the radius of a far one.  These join
  exactly: further pivots take their near points out as long as each takes a fixed share, the rest
  is compared by intersection counts.  What is left of a cell above a fixed size is dealt into
  blocks, and every pair of blocks joins in its own task.

Only spanning links leave a cell.  Components are found by star contraction over shuffles.

Frequent shingles come last in the order, so passages shared by many documents form no regions.
Their counts are lower bounds: what a task meets once among COUNT_AT_ONCE shingles is left out.  The
list that is sent to tasks has a fixed size; the order only decides on time, never on results.
Points are identified by 64-bit digests of their sets; where two sets share one, which a second
digest tells, they are renamed.

Null and empty texts, and texts without words, have no shingle and are linked with nothing.
Repeated rows are each returned.  Rows with a null id take part as copies of their text but name
no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.blocks import Block, blocks, grams, mix
from sedimenta.llm.components import components
from sedimenta.llm.tables import Scratch, bitmap, marked

#: Words of a shingle, and the similarity as a fraction.
WIDTH, NUM, DEN = 5, 3, 4
#: Shingles on the list of frequent ones, at most, and the least count to be on it.
FREQUENT, FREQUENT_MIN = 1 << 18, 6
#: Points of a region whose pairs are formed directly, and rows that a task folds before it hands them out.
SMALL, FOLD = 32, 300_000
#: Far points and bytes of a cell's block, near points of one, and points of a part that is compared directly.
CELL, CELL_BYTES, NEAR, LEAF = 6000, 32 << 20, 500, 384
#: Points and shingles of a tile: what is compared, or measured, at once.
TILE, TILE_SHINGLES = 1500, 1 << 19
#: The share of points that a pivot must take out of a cell, or the rest is compared directly; pivots tried at once.
TAKEN, TRIED = 1 / 4, 4
#: Members of a shingle up to which its pairs are counted one by one.
RARE = 24
#: Least and most bits of a parity sketch; between, the first power of two that the set's size reaches.
SKETCH = (256, 1 << 14)
#: Shingles that a task counts at once.
COUNT_AT_ONCE = 1_000_000

_I = np.int64


def sets(b: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hash, document) of a block, sorted by document and hash."""
    s, e, d = b.words()
    h = b.hashes(s, e, lower=True)
    g, at = grams(h, d, width)
    hs, ds = [g], [d[at]]
    n = np.bincount(d, minlength=b.n)
    short = n[d] < width  # few texts: the whole sequence is their one shingle
    h, d = h[short], d[short]
    for k in range(1, width):
        g, at = grams(h, d, k)
        own = n[d[at]] == k
        hs.append(g[own])
        ds.append(d[at][own])
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.argsort(h)  # then by document, a small number, which sorts in linear time
    order = order[np.argsort(d[order].astype(np.uint16 if b.n < 1 << 16 else _I), kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def bounds(d: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(d, np.arange(n + 1))


def digests(h: np.ndarray, at: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set between bounds, independent of order; the first is 0 for empty sets.

    shared has first digests that several sets have; these are renamed by the second.
    """
    size = np.diff(at).astype(np.uint64)
    out = []
    for salt in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h * np.uint64(salt) + np.uint64(7)), out=c[1:])
        out.append(np.where(size > 0, mix(c[at[1:]] - c[at[:-1]] + size).view(_I), 0))
    point, check = out
    if shared is not None and len(shared):
        point = np.where(np.isin(point, shared), point ^ check, point)
    return point, check


def sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bitmaps of the sets between bounds: the xor of two has at most as many bits as the sets' symmetric difference."""
    n = np.diff(at)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(_I), *SKETCH)
    cell = mix(h)
    out = [b""] * len(n)
    for w in np.unique(bits).tolist():
        docs = np.flatnonzero((bits == w) & (n > 0))
        step = max(1, (1 << 20) // w)
        for k in range(0, len(docs), step):
            some = docs[k : k + step]
            rows = np.arange(n[some].sum()) + np.repeat(at[some] - (np.cumsum(n[some]) - n[some]), n[some])
            where = np.repeat(np.arange(len(some)), n[some]) * w + (cell[rows] & np.uint64(w - 1)).astype(_I)
            maps = np.packbits((np.bincount(where, minlength=len(some) * w) & 1).astype(np.uint8).reshape(len(some), w), axis=1)
            for i, d in enumerate(some.tolist()):
                out[d] = maps[i].tobytes()
    return out


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Lower bounds of symmetric differences from pairs of sketches; the longer is folded to the shorter's size."""
    out = np.zeros(len(x), _I)
    size = np.array([(len(a) // 8, len(b) // 8) for a, b in zip(x, y, strict=True)], _I).reshape(-1, 2)
    for n in np.unique(size, axis=0):
        rows = np.flatnonzero((size == n).all(1))
        a, b = (np.frombuffer(b"".join(c[k] for k in rows), np.uint64).reshape(len(rows), -1) for c in (x, y))
        while a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
        while b.shape[1] > a.shape[1]:
            b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
        out[rows] = np.bitwise_count(a ^ b).sum(1, dtype=_I)
    return out


def overlaps(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the intersections of pairs of sets, and of the sets (bytes of distinct 64-bit shingles)."""
    n, m = (np.array([len(a) // 8 for a in c], _I) for c in (x, y))
    both = np.frombuffer(b"".join([*x, *y]), np.uint64)
    row = np.concatenate([np.repeat(np.arange(len(x)), k) for k in (n, m)])
    order = np.lexsort((both, row))
    both, row = both[order], row[order]
    same = row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])]
    return np.bincount(same, minlength=len(x)), n, m


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1)):
            h, d = sets(b)
            at = bounds(d, b.n)
            point, check = digests(h, at)
            yield pa.RecordBatch.from_arrays([batch.column(0)[b.rows], pa.array(np.diff(at)), pa.array(point), pa.array(check), pa.array(sketches(h, at), pa.binary())], ["doc_id", "n_shingles", "point", "check", "sketch"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that some points of this task share, with their counts."""
    seen: set[int] = set()
    kept: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(kept), return_counts=True)
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(u[n > 1].view(_I)), pa.array(n[n > 1])], ["s", "n"])

    for batch in batches:
        for b in blocks(batch.column(0)):
            h, d = sets(b)
            at = bounds(d, b.n)
            new = _new(digests(h, at)[0], seen)
            kept.append(h[new[d]])
            if sum(map(len, kept)) > COUNT_AT_ONCE:
                yield flush()
    if kept:
        yield flush()


def _new(points: np.ndarray, seen: set[int]) -> np.ndarray:
    """Points (0: none) that this task meets first."""
    new = np.zeros(len(points), bool)
    for k, p in enumerate(points.tolist()):
        if p and p not in seen:
            seen.add(p)
            new[k] = True
    return new


def frequent(texts: DataFrame, scratch: Scratch, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and their counts, about most of them.

    Of the counts that the list has room for in part only, a share is taken by a hash.
    """
    counts = scratch.write(texts.mapInArrow(_counts, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_MIN), "frequent")
    step = F.floor(8 * F.log2("n")).alias("step")  # a few hundred steps, whatever the counts
    room, shares = most, []
    for r in counts.groupBy(step).count().orderBy(F.desc("step")).collect():
        shares.append((r["step"], min(1.0, room / r["count"])))
        room -= r["count"]
        if room <= 0:
            break
    if not shares:
        return np.zeros(0, np.uint64), np.zeros(0, _I)
    last, share = shares[-1]
    some = F.pmod(F.xxhash64(F.lit(3), "s"), F.lit(1 << 20)) < int(share * (1 << 20))
    got = counts.where((step > last) | ((step == last) & some)).toPandas()
    s, n = got["s"].to_numpy(_I).view(np.uint64), got["n"].to_numpy(_I)
    order = np.argsort(s)
    return s[order], n[order]


def prefixes(h: np.ndarray, d: np.ndarray, at: np.ndarray, listed: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each set's prefix in the global order: hash, document, place."""
    rank = np.zeros(len(h), _I)
    if len(listed):
        k = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        rank = np.where(listed[k] == h, often[k], 0)
    order = np.lexsort((h, rank, d))
    h, d = h[order], d[order]
    n = np.diff(at)
    place = np.arange(len(h)) - at[d]
    first = place < (n - (NUM * n + DEN - 1) // DEN + 1)[d]
    return h[first], d[first], place[first]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows s, point, size_place sorted by s and point, to pairs (star false) and points of cells (star true)."""
    rest: list[np.ndarray] = [np.zeros(0, _I)] * 3
    open_s, open_pivot = None, 0  # a region whose first part has been handed out

    held: list[np.ndarray] = []

    def folded() -> Iterator[pa.RecordBatch]:
        if held:
            u = np.unique(np.concatenate(held, axis=1), axis=1)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1]), pa.array(u[2] != 0)], ["a", "b", "star"])

    def handle(s: np.ndarray, p: np.ndarray, x: np.ndarray) -> None:
        if not len(s):
            return
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
        s, p, x = s[new], p[new], x[new]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(s)))
        group = np.cumsum(first) - 1
        pivot = p[start][group]
        large = (size > SMALL)[group]
        if open_s is not None and s[0] == open_s:
            large[group == 0] = True
            pivot[group == 0] = open_pivot
        n, place = x >> 31, x & ((1 << 31) - 1)
        a, b, star = [pivot[large]], [p[large]], [np.ones(int(large.sum()), bool)]
        for lag in range(1, SMALL):
            i = np.flatnonzero((s[lag:] == s[:-lag]) & ~large[lag:]) if len(s) > lag else np.zeros(0, _I)
            j = i + lag
            common = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) - 1
            ok = (DEN + NUM) * np.minimum(common, np.minimum(n[i], n[j])) >= NUM * (n[i] + n[j])
            a.append(p[i[ok]])
            b.append(p[j[ok]])
            star.append(np.zeros(int(ok.sum()), bool))
        a, b, star = map(np.concatenate, (a, b, star))
        if len(a):
            held.append(np.stack([a, b, star.astype(_I)]))

    for batch in batches:
        cols = [np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest)]
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if cut:
            handle(*(c[:cut] for c in cols))
            open_s = None if open_s != cols[0][-1] else open_s
        rest = [c[cut:] for c in cols]
        if len(rest[0]) > 20_000:  # one large region: its points go to its pivot part by part
            pivot = open_pivot if open_s == rest[0][0] else int(rest[1][0])
            open_s, open_pivot = int(rest[0][0]), pivot
            handle(*rest)
            rest = [r[:0] for r in rest]
        if sum(x.shape[1] for x in held) > FOLD:
            yield from folded()
    handle(*rest)
    yield from folded()


def within(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with both in common are within the radius."""
    return (DEN + NUM) * both >= NUM * (n + m)


def link_matrix(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Which pairs of sets (left with right, or with each other) are within the radius, from their intersection counts.

    Shingles with the same members count as one column with a weight.  Columns of few members count
    their pairs, the others are multiplied as matrices.
    """
    sides = left if right is None else [*left, *right]
    n, m = len(left), len(sides)
    size = np.array([len(x) for x in sides], np.float32)
    every = np.concatenate(sides)
    who = np.repeat(np.arange(m), size.astype(int))
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    start = np.flatnonzero(new)
    df = np.diff(np.append(start, len(every)))
    tag = np.zeros(len(every) + 1, np.uint64)
    np.cumsum(mix(who.astype(np.uint64) + np.uint64(1)), out=tag[1:])
    sign = np.where(df > 1, tag[start + df] - tag[start], 0)
    _, pick, weight = np.unique(sign, return_index=True, return_counts=True)
    use = df[pick] > 1
    pick, weight = pick[use], weight[use].astype(np.float32)
    first = 0 if right is None else n  # where the right side begins
    both = np.zeros((n, m - first), np.float32)
    for d in np.unique(df[pick][df[pick] <= RARE]).tolist():
        cols = np.flatnonzero(df[pick] == d)
        for k in range(0, len(cols), max(1, 2_000_000 // (d * d))):
            some = cols[k : k + max(1, 2_000_000 // (d * d))]
            rows = who[start[pick[some]][:, None] + np.arange(d)]
            x, y = np.repeat(rows, d, axis=1).ravel(), np.tile(rows, (1, d)).ravel()
            w = np.repeat(weight[some], d * d)
            ok = (x < n) & (y >= first)
            both += np.bincount(x[ok] * (m - first) + (y[ok] - first), w[ok], n * (m - first)).reshape(both.shape).astype(np.float32)
    wide = np.flatnonzero(df[pick] > RARE)
    for a in range(0, len(wide), 2048):
        some = wide[a : a + 2048]
        x = np.zeros((m, len(some)), np.float32)
        long = df[pick[some]]
        at = np.repeat(start[pick[some]] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        x[who[at], np.repeat(np.arange(len(some)), long)] = 1
        both += (x[:n] * weight[some]) @ x[first:].T
    return within(both, size[:n, None], size[None, first:])


class Forest:
    """Union-find that remembers the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int, tell: bool = True) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            if tell:
                self.links.append((x, y))


def tiles(rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """rows in parts of at most TILE points and about TILE_SHINGLES shingles."""
    before = np.cumsum(size[rows]) - size[rows]
    part = np.maximum(before // TILE_SHINGLES, 0)
    new = np.flatnonzero(np.diff(part)) + 1
    return [t for p in np.split(rows, new) for t in np.split(p, range(TILE, len(p), TILE)) if len(t)]


def join_cell(members: list[np.ndarray], forest: Forest) -> None:
    """Links all members of a cell that are within the radius, directly or over others.

    A pivot takes out the members within its radius: they are linked over it.  Each pair of the others,
    and of those with members just taken out that may be within the radius, is compared once.
    """
    rows, size = np.arange(len(members)), np.array([len(x) for x in members], _I)
    radius = 1 - NUM / DEN + 1e-9
    while len(rows) > LEAF:
        pivots = rows[:: max(1, len(rows) // TRIED)][:TRIED].tolist()
        both = np.zeros((len(pivots), len(rows)))
        done = 0
        for t in tiles(rows, size):
            every, who = np.concatenate([members[k] for k in t]), np.repeat(np.arange(len(t)), size[t])
            for i, pivot in enumerate(pivots):
                x = members[pivot]
                both[i, done : done + len(t)] = np.bincount(who, x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every, len(t))
            done += len(t)
        near = np.stack([within(both[i], size[rows], size[p]) for i, p in enumerate(pivots)])
        best = int(near.sum(1).argmax())
        pivot, near, both = pivots[best], near[best], both[best]
        d = 1 - both / (size[rows] + size[pivot] - both)
        if near.sum() < TAKEN * len(rows):
            break
        for k in rows[near].tolist():
            forest.link(pivot, k)
        if not near.all():
            edge = near & (d >= d[~near].min() - radius)
            compare(members, size, forest, rows[~near], rows[edge])
        rows = rows[~near]
    compare(members, size, forest, rows)


def compare(members: list[np.ndarray], size: np.ndarray, forest: Forest, left: np.ndarray, right: np.ndarray | None = None) -> None:
    """Links the pairs of left and right (or of left) within the radius, by tiles whose sizes allow it."""
    cut = lambda rows: tiles(rows[np.argsort(size[rows], kind="stable")], size)
    one = cut(left)
    two = one if right is None else cut(right)
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            if right is None and j < i or DEN * size[x[-1]] < NUM * size[y[0]] or DEN * size[y[-1]] < NUM * size[x[0]]:
                continue
            same = right is None and i == j
            linked = link_matrix([members[k] for k in x], None if same else [members[k] for k in y])
            for a, b in zip(*np.nonzero(np.tril(linked, -1) if same else linked), strict=True):
                forest.link(int(x[a]), int(y[b]))


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The links of two blocks of a cell: of its far members, or of far and near ones, the near being linked already."""
    pdf = pdf.drop_duplicates("b").sort_values(["near", "b"], ignore_index=True)
    members = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    forest, far = Forest(len(members)), int((~pdf["near"].to_numpy(bool)).sum())
    if far == len(members):
        join_cell(members, forest)
    else:
        for k in range(far + 1, len(members)):
            forest.link(far, k, tell=False)
        compare(members, np.array([len(x) for x in members], _I), forest, np.arange(far), np.arange(far, len(members)))
    ids, pairs = pdf["b"].to_numpy(), np.array(forest.links, _I).reshape(-1, 2)
    return pd.DataFrame({"u": ids[pairs[:, 0]], "v": ids[pairs[:, 1]]})


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow them to be within the radius."""
    for batch in batches:
        if batch.num_rows:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            bound = apart(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            keep = pa.array((DEN + NUM) * bound <= (DEN - NUM) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b with their sets, to whether they are within the radius, their distance, and the bytes of b's set; some at a time."""
    for batch in batches:
        if batch.num_rows:
            size = sum(pa.compute.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(_I) for k in (2, 3)) // 8
            for rows in tiles(np.arange(batch.num_rows), size):
                part = batch.slice(int(rows[0]), len(rows))
                both, n, m = overlaps(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(within(both, n, m)), pa.array(1 - both / (n + m - both)), pa.array(8 * m)], ["a", "b", "near", "d", "bytes"])


def links(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(profiles: doc_id, n_shingles, point, sketch; links between points: u, v, enough to span all components)."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    profiles = scratch.write(docs.select("doc_id", "text").mapInArrow(_profiles, f"doc_id {kind}, n_shingles long, point long, check long, sketch binary"), "profiles")
    twice = profiles.where("n_shingles > 0").groupBy("point").agg((F.min("check") != F.max("check")).alias("shared")).where("shared")
    shared = np.array([r["point"] for r in twice.collect()], _I)  # n * n / 2 ** 65 are expected: 3 of 10 ** 10 sets
    if len(shared):
        profiles = profiles.withColumn("point", F.when(F.col("point").isin(shared.tolist()), F.col("point").bitwiseXOR(F.col("check"))).otherwise(F.col("point")))
    texts = docs.select("text")
    order = spark.sparkContext.broadcast(frequent(texts, scratch))  # at most FREQUENT entries

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                h, d = sets(b)
                at = bounds(d, b.n)
                point, _ = digests(h, at, shared)
                s, d, r = prefixes(h, d, at, *order.value)
                use = _new(point, seen)[d]
                s, d, r = s[use], d[use], r[use]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(_I)), pa.array(point[d]), pa.array((np.diff(at)[d] << 31) | r)], ["s", "point", "size_place"])

    regions = texts.mapInArrow(place, "s long, point long, size_place long").repartition("s").sortWithinPartitions("s", "point")
    found = scratch.write(regions.mapInArrow(_regions, "a long, b long, star boolean"), "regions")
    scratch.drop("frequent")

    # small regions give pairs, thinned by sketches
    points = profiles.where("n_shingles > 0").dropDuplicates(["point"])
    one = lambda name: points.select(F.col("point").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"k_{name}"))
    pairs = found.where("not star").select("a", "b").distinct().join(one("a"), "a").join(one("b"), "b")
    pairs = scratch.write(pairs.select("a", "b", "n_a", "k_a", "n_b", "k_b").mapInArrow(_thin, "a long, b long"), "pairs")

    # the sets of the points that pairs and cells need; large regions give cells around document pivots
    cells = found.where("star").select("a", "b").distinct()
    wanted = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).union(found.where("star").select("b")).distinct()
    bits = spark.sparkContext.broadcast(bitmap(wanted, wanted.count()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                h, d = sets(b)
                at = bounds(d, b.n)
                point, _ = digests(h, at, shared)
                use = np.flatnonzero(marked(bits.value, point))
                use = use[_new(point[use], seen)]
                yield pa.RecordBatch.from_arrays([pa.array(point[use]), pa.array([h[at[k] : at[k + 1]].tobytes() for k in use], pa.binary())], ["point", "shingles"])

    members = texts.mapInArrow(fetch, "point long, shingles binary").join(wanted, "point", "left_semi").dropDuplicates(["point"])
    members = scratch.write(members, "members")
    scratch.drop()
    of = lambda name: members.select(F.col("point").alias(name), F.col("shingles").alias(f"x_{name}"))
    both = lambda df: df.join(of("b"), "b").join(of("a"), "a").select("a", "b", "x_a", "x_b").mapInArrow(_measured, "a long, b long, near boolean, d double, bytes long")
    close = scratch.write(both(pairs).where("near").select(F.col("a").alias("u"), F.col("b").alias("v")), "close")
    rays = scratch.write(both(cells), "rays")
    scratch.drop("regions", "pairs")
    out = close.union(rays.where("near").select("a", "b"))

    # a cell's far points, and the near ones that one of them may reach
    far = rays.where("not near").groupBy("a").agg(F.min("d").alias("least"))
    open_ = rays.join(far, "a").where(F.expr("not near") | (F.col("d") >= F.col("least") - (1 - NUM / DEN) - 1e-9)).select("a", "b", "near", "bytes")
    open_ = scratch.write(open_, "open")
    many = lambda kind, points: F.greatest(F.ceil(F.count_if(kind) / F.lit(points)), F.ceil(F.sum(F.when(kind, F.col("bytes"))) / F.lit(CELL_BYTES))).cast("int")
    count = open_.groupBy("a").agg(many(~F.col("near"), CELL).alias("n_far"), F.coalesce(many(F.col("near"), NEAR), F.lit(0)).alias("n_near"), F.count("*").alias("rows")).where("rows > 1")
    # far blocks are numbered first; they meet every block, near ones meet the far ones only
    own = F.when(F.col("near"), F.col("n_far") + F.pmod(F.xxhash64("b"), F.col("n_near"))).otherwise(F.pmod(F.xxhash64("b"), F.col("n_far"))).cast("int")
    dealt = open_.join(count, "a").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_far") + F.when(F.col("near"), 0).otherwise(F.col("n_near")) - 1))).select("a", "b", "near", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rest = dealt.join(of("b"), "b").select("a", "i", "j", "b", "near", F.col("x_b").alias("shingles")).groupBy("a", "i", "j").applyInPandas(_cell, "u long, v long")
    return profiles, out.union(rest)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links) of each row."""
    scratch = Scratch(docs.sparkSession)
    profiles, edges = links(docs, scratch)
    roots = components(edges)
    least = profiles.where("n_shingles > 0").groupBy("point").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, F.col("point") == F.col("node"), "left").select("point", "least", F.coalesce("root", "point").alias("root"))
    least = scratch.write(least, "least")
    scratch.drop("members", "close", "rays", "open")
    named = least.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("component_id"))
    named = scratch.write(least.join(named, F.col("root") == F.col("name")).select(F.col("point").alias("of"), "component_id"), "named")
    scratch.drop("least")
    out = profiles.select("doc_id", "n_shingles", "point").join(named, F.col("point") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar documents, the one with the least id, with all columns.

    Rows that share id and text stay or go together; rows that share an id only are judged apart, and
    of those of one group the one with the least digest of its text stays.  Rows with a null id stay.
    Columns may have any names: rows travel whole in one column.
    """
    digest = F.xxhash64("text")
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", digest.alias("digest"))).alias("doc_id"), "text")
    gone = similar(keyed).where("doc_id <> component_id").select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.digest").alias("gone_digest")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("digest"))
    return rows.join(gone, (F.col("row.doc_id") == F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti").select("row.*")
