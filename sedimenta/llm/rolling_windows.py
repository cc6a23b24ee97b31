"""Features of the time before each document: counts, sums, languages and quantiles of a source's last seconds.

A window of W seconds before an event at t holds the rows of the same source with t - W <= time < t;
rows of the same second are no part of each other's windows.  Rows of a source are swept in order of
time by two pointers: what comes in is added, what is too old leaves.  Each quantile is kept by two
heaps, the lower one up to the target rank; a row that leaves is only marked (a tombstone) and goes
when it comes to a heap's top, or when more are marked than live.  As the number of lengths changes,
so does the target rank, and tops move from heap to heap.  Languages are counted by reference.

Time is cut into slabs as long as the longest window.  A slab is swept with the rows of the slab
before it, which fill its first windows, so a source of any share is spread over as many tasks as it
has slabs; each row travels twice, without its text.  Rows arrive sorted, and a task holds one window
of one source, not a slab: memory follows the rows of W seconds and never the table.

Rows without a length (null text) count as events and as languages only.  A null source is a source
of its own.  A row without an id has no time: its windows are empty.  Rows that repeat an id are rows
of one second.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the windows, and the quantiles as (numerator, denominator) of the rank.
WIDTHS = (600, 43_200)
SHARES = {"median": (1, 2), "high": (9, 10)}
#: Tombstones that a pair of heaps may hold beyond its live rows, and rows of a batch that goes back to Spark.
SPARE, OUT_ROWS = 64, 20_000


class RankHeaps:
    """The value at rank ceil(num * m / den) of m values that come and go; each has a key of its own."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low: list[tuple[int, int]] = []  # negated: its top is the largest
        self.high: list[tuple[int, int]] = []
        self.dead: set[int] = set()
        self.n_low = self.n_high = 0

    def _clear_tops(self) -> None:
        while self.low and -self.low[0][1] in self.dead:
            self.dead.remove(-heappop(self.low)[1])
        while self.high and self.high[0][1] in self.dead:
            self.dead.remove(heappop(self.high)[1])

    def _is_low(self, value: int, key: int) -> bool:
        return self.n_low > 0 and (-value, -key) >= self.low[0]

    def add(self, value: int, key: int) -> None:
        if self._is_low(value, key):
            heappush(self.low, (-value, -key))
            self.n_low += 1
        else:
            heappush(self.high, (value, key))
            self.n_high += 1

    def remove(self, value: int, key: int) -> None:
        if self._is_low(value, key):
            self.n_low -= 1
        else:
            self.n_high -= 1
        self.dead.add(key)
        self._clear_tops()
        if len(self.dead) > self.n_low + self.n_high + SPARE:
            self.low = [x for x in self.low if -x[1] not in self.dead]
            self.high = [x for x in self.high if x[1] not in self.dead]
            self.dead.clear()
            heapify(self.low)
            heapify(self.high)

    def value(self) -> int | None:
        want = -(-self.num * (self.n_low + self.n_high) // self.den)
        while self.n_low < want:
            v, k = heappop(self.high)
            heappush(self.low, (-v, -k))
            self.n_low, self.n_high = self.n_low + 1, self.n_high - 1
            self._clear_tops()
        while self.n_low > want:
            v, k = heappop(self.low)
            heappush(self.high, (-v, -k))
            self.n_low, self.n_high = self.n_low - 1, self.n_high + 1
            self._clear_tops()
        return -self.low[0][0] if want else None


class Sliding:
    """One window of one source: rows are added in order of time and leave at its far end."""

    def __init__(self, width: int, shares: list[tuple[int, int]]):
        self.width, self.rows, self.total, self.next = width, deque(), 0, 0
        self.langs: dict[str, int] = {}
        self.heaps = [RankHeaps(*s) for s in shares]

    def add(self, at: int, length: int | None, lang: str | None) -> None:
        self.rows.append((at, length, lang, self.next))
        if length is not None:
            self.total += length
            for h in self.heaps:
                h.add(length, self.next)
        if lang is not None:
            self.langs[lang] = self.langs.get(lang, 0) + 1
        self.next += 1

    def before(self, at: int) -> tuple:
        """(rows, sum of lengths, languages, the quantiles) of the window that ends at a time; older rows leave."""
        while self.rows and self.rows[0][0] < at - self.width:
            _, length, lang, key = self.rows.popleft()
            if length is not None:
                self.total -= length
                for h in self.heaps:
                    h.remove(length, key)
            if lang is not None:
                self.langs[lang] -= 1
                if not self.langs[lang]:
                    del self.langs[lang]
        return len(self.rows), self.total, len(self.langs), *(h.value() for h in self.heaps)


def _sweep(widths: tuple[int, ...], shares: list[tuple[int, int]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group = now = None
        windows: list[Sliding] = []
        same: list[tuple] = []  # rows of the second at hand, not added yet
        found: list[tuple] = []
        kind = None
        for batch in batches:
            kind = kind or [batch.schema.field(4).type, *[pa.int64()] * (len(names) - 1)]
            for source, slab, at, own, doc, length, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (source, slab):
                    group, now, windows, same = (source, slab), None, [Sliding(w, shares) for w in widths], []
                if at != now:
                    for row in same:
                        for w in windows:
                            w.add(*row)
                    now, same, found = at, [], []
                same.append((at, length, lang))
                if own:
                    found = found or [w.before(at) for w in windows]
                    out += [(doc, w.width, at, *f) for w, f in zip(windows, found, strict=True)]
            if len(out) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names)

    return run


def event_second(doc_id: str = "doc_id") -> Column:
    """60 * floor((id + crc32 of its digits mod 10000) / 6)."""
    x = F.col(doc_id) + F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10_000
    return 60 * F.call_function("div", x - F.pmod(x, F.lit(6)), F.lit(6))


def features(docs: DataFrame, *, at: Column | None = None, widths: tuple[int, ...] = WIDTHS, shares: dict[str, tuple[int, int]] = SHARES) -> DataFrame:
    """doc_id, window_s, event_s, n_events, sum_chars, n_langs and <name>_chars of each quantile, for each row and width.

    docs(doc_id, text, source, lang); at: the time of a row in whole seconds, by default from its id.
    """
    at = event_second() if at is None else at
    rows = docs.select("doc_id", "source", "lang", at.cast("long").alias("at"), F.char_length("text").cast("long").alias("length"))
    slab = F.floor(F.col("at") / max(widths))
    cut = rows.where("at is not null").withColumn("slab", F.explode(F.array(slab, slab + 1))).withColumn("own", F.col("slab") == slab)
    cut = cut.select("source", "slab", "at", "own", "doc_id", "length", "lang").repartition("source", "slab").sortWithinPartitions("source", "slab", "at")
    names = ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", *(f"{s}_chars" for s in shares)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = cut.mapInArrow(_sweep(tuple(widths), list(shares.values()), names), f"doc_id {kind}, {', '.join(f'{n} long' for n in names[1:])}")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    lost = rows.where("at is null").select("doc_id", F.explode(F.array(*(F.lit(w).cast("long") for w in widths))).alias("window_s"), none.alias("event_s"), *(zero.alias(n) for n in names[3:6]), *(none.alias(n) for n in names[6:]))
    return got.unionByName(lost)
