"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most ``capacity`` tokens; full pieces are sequences by
themselves, the rest are packed by best fit, longest first.  Open bins are kept in order of their
free room; each carries a bitmap of its sources and one of its duplicate clusters.  The search
starts at the tightest bin that is large enough and goes on to its successors until one is
compatible: no second document of a cluster, at most ``max_sources`` sources, and no two sources
that are kept apart.  If none is, a new bin opens.

Rows are dealt by a hash of their id and place in the table into blocks of bounded size, each packed
by itself; copies, and rows without an id, spread evenly, so a large cluster loads all blocks alike.
Where a column holds training positions, blocks are ranges of it instead, so that bin ids follow
training order from block to block.  Null and empty texts have no token and get no bin (null).
Repeated rows, and rows without an id, are packed each, copies in different bins.  An empty table
gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.mixing import n_words
from sedimenta.llm.tables import written

#: Tokens of a sequence.
CAPACITY = 2048
#: Sources that may share a sequence.
MAX_SOURCES = 4
#: Tokens and rows of a block, about.
BLOCK_TOKENS, BLOCK_ROWS = 4_000_000, 20_000
#: Tasks at most (beyond that a task packs several blocks in turn), and rows of a batch that goes back to Spark.
PARTITIONS, OUT_ROWS = 20_000, 10_000


def pack(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int, max_sources: int, apart: Sequence[int]) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; sources are small numbers, a cluster of -1 conflicts with none.

    apart[s] is the bitmap of sources that may not share a bin with s.
    """
    bins, at = [0] * len(sizes), [0] * len(sizes)
    rooms: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    has_source: list[int] = []
    has_cluster: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, s = sizes[i], 1 << sources[i]
        c = 1 << clusters[i] if clusters[i] >= 0 else 0
        for k in range(bisect_left(rooms, (size, -1)), len(rooms)):
            b = rooms[k][1]
            if not has_cluster[b] & c and not has_source[b] & apart[sources[i]] and (has_source[b] & s or has_source[b].bit_count() < max_sources):
                room = rooms.pop(k)[0]
                break
        else:
            b, room = len(has_source), capacity
            has_source.append(0)
            has_cluster.append(0)
        bins[i], at[i] = b, capacity - room
        has_source[b] |= s
        has_cluster[b] |= c
        if room > size:
            insort(rooms, (room - size, b))
    return bins, at


def _packed(rows: list[tuple], capacity: int, max_sources: int, apart: Sequence[tuple[str, str]], first: int) -> tuple[list[tuple], int]:
    """Pieces of a block's rows (doc_id, source, n_tokens, cluster), bins numbered from first; and the next number."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0] is not None, r[0] or "", r[3]))
    names = sorted({r[1] for r in rows if r[1] is not None} | {y for p in apart for y in p}) + [None]
    number = {x: k for k, x in enumerate(names)}
    mask = [0] * len(names)
    for x, y in apart:
        mask[number[x]] |= 1 << number[y]
        mask[number[y]] |= 1 << number[x]
    twice = {c: k for k, c in enumerate(sorted(c for c, n in Counter(r[3] for r in rows).items() if n > 1))}
    out: list[tuple] = []
    rest: list[tuple] = []
    for doc, source, n, cluster in rows:
        if not n:
            out.append((doc, 0, 0, 0, None, None))
        for piece in range(n // capacity):
            out.append((doc, piece, piece * capacity, capacity, first, 0))
            first += 1
        if n % capacity:
            rest.append((doc, n // capacity, n // capacity * capacity, n % capacity, number[source], twice.get(cluster, -1)))
    bins, at = pack([r[3] for r in rest], [r[4] for r in rest], [r[5] for r in rest], capacity, max_sources, mask)
    out += [(*r[:4], first + b, a) for r, b, a in zip(rest, bins, at, strict=True)]
    return out, first + max(bins, default=-1) + 1


def pack_documents(
    docs: DataFrame, *, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES, apart: Sequence[tuple[str, str]] = (), place: str | None = None, cluster: str | None = None
) -> DataFrame:
    """doc_id, piece, start (first token), n_tokens, bin_id and offset (place in its bin) of every piece.

    Tokens are words; the duplicate cluster is the column that cluster names, or else a digest of the
    words in lower case.  place names the column of training positions, if there is one.
    """
    words = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")))
    digest = F.xxhash64(F.col(f"`{cluster}`") if cluster else words)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", n_words().alias("n_tokens"), digest.alias("cluster"), (F.col(f"`{place}`").cast("double") if place else F.lit(None).cast("double")).alias("place"))
    rows = written(rows, "sizes")  # narrow; texts are read once
    total = rows.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    blocks = max(1, math.ceil((total["t"] or 0) / BLOCK_TOKENS), math.ceil(total["n"] / BLOCK_ROWS))
    most_rows, most_tokens = 2 * BLOCK_ROWS, 2 * BLOCK_TOKENS
    names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "offset"]
    kinds = [pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tokens, bin_ = 0, TaskContext.get().partitionId() << 32

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal bin_, tokens
            out, bin_ = _packed(held, capacity, max_sources, apart, bin_)
            held.clear()
            tokens = 0
            for k in range(0, len(out), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + OUT_ROWS], strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(held) >= most_rows or tokens >= most_tokens:
                    yield from block()
                held.append(row)
                tokens += row[2]
        if held:
            yield from block()

    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # fixed by the table's files
    if place:
        dealt = salted.repartitionByRange(min(blocks, PARTITIONS), "place", "salt").sortWithinPartitions("place", "salt")
    else:
        dealt = salted.repartition(min(blocks, PARTITIONS), F.xxhash64(F.lit(5), "doc_id", "salt"))
    packed = dealt.select("doc_id", "source", "n_tokens", "cluster").mapInArrow(run, "doc_id string, piece long, start long, n_tokens long, bin_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
