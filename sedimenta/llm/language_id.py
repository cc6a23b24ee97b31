"""Language identification with bit-sliced n-gram filters.

One Bloom filter per language over the n-grams of its words, stored slice-wise: a slot holds a
bitmask with one bit per language, so that a single lookup per hash function, and'ed together,
returns all languages that contain an n-gram.  A document's n-grams are counted per language by
the bits of these masks, an n-gram of several languages as a part for each; the counts are corrected
for the filters' false positives, and the largest share decides (ties: the first language by code
point).  A slot has as many 64-bit words as the languages need.

Every language is learned, from a hash sample of its training rows, of long texts from pieces drawn
over their whole length: an n-gram belongs to each language that holds it in a few of these.  Texts that are null or hold
no letter are `und`, score 0.  A text with letters but without any known n-gram gets the most
frequent language, score 0; without any learned language, `und`.  Repeated rows are each returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.blocks import LOWER, Block, blocks, mix
from sedimenta.llm.tables import pieces, remainder

#: Languages that a word of a mask holds.
WORD_BITS = 64
#: Documents per language that are learned from, about (a sample by hash of the id; fewer beyond 64 languages), and characters taken of each, in as many pieces where it is longer.
TRAIN_ROWS, TEXT_CHARS, PIECES = 1500, 20_000, 20
#: Salt of the hash that orders them.
SALT = 8
#: Slots of the filters and hash functions.
SLOTS, HASHES = 1 << 21, 3
#: n-gram lengths in bytes, the word's edges included.
SIZES = (2, 3, 4, 5)
#: Training texts that must hold an n-gram.
MIN_DOCS = 3

#: The bits of each byte.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)
WORD = np.zeros(256, bool)
WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def ngrams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the text's words in lower case, each word edged by blanks."""
    inside = WORD[b.data]
    clean = Block(np.where(inside, LOWER[b.data], 32).astype(np.uint8), b.offs, b.first)
    s, e, d = clean.spans(inside)
    out, docs = [], []
    for n in SIZES:
        # grams inside words
        room = np.maximum(e - s - n + 1, 0)
        first = np.repeat(s - np.concatenate([[0], np.cumsum(room)[:-1]]) if len(s) else s, room)
        at = np.arange(len(first)) + first
        out.append(mix(clean.hashes(at, at + n) + np.uint64(1)))
        docs.append(np.repeat(d, room))
        # word beginnings, word ends and whole words
        for mark, m in ((2, e - s >= n - 1), (3, e - s >= n - 1)):
            a = s[m] if mark == 2 else e[m] - (n - 1)
            out.append(mix(clean.hashes(a, a + n - 1) + np.uint64(mark)))
            docs.append(d[m])
    short = e - s < SIZES[-1]
    out.append(mix(clean.hashes(s[short], e[short]) + np.uint64(4)))
    docs.append(d[short])
    return np.concatenate(out), np.concatenate(docs)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # word, slot
    fill: np.ndarray  # false-positive rate of each language
    common: int  # the most frequent language

    @staticmethod
    def places(h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) & np.uint64(SLOTS - 1)).view(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, as bits of its words."""
        out = None
        for at in self.places(h):
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def decide(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        h, d = ngrams(b)
        m = self.masks(h)
        total = np.bincount(d, minlength=b.n)
        part = 1 / np.maximum(np.bitwise_count(m).sum(0, dtype=np.int64), 1)
        votes = np.zeros((len(self.languages), b.n))
        # eight languages at a time: parts are summed by document and byte of the mask, then dealt to the byte's bits
        for k in range(0, len(self.languages), 8):
            byte = ((m[k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(255)).view(np.int64)
            hits = (np.bincount(d * 256 + byte, part, b.n * 256).reshape(b.n, 256) @ _BITS).T[: len(self.languages) - k]
            own = self.fill[k : k + 8, None]
            votes[k : k + 8] = np.maximum(hits - own * total, 0) / (1 - own)
        best, mass = votes.argmax(0), votes.sum(0)
        none = mass <= 0
        best[none] = self.common
        return best, np.where(none, 0.0, votes.max(0) / np.maximum(mass, 1e-12))


def build(texts: list[str], langs: list[str], *, min_docs: int = MIN_DOCS) -> Filters:
    names = sorted(set(langs))
    slots = np.zeros((max(1, -(-len(names) // WORD_BITS)), SLOTS), np.uint64)
    own: dict[str, list[str]] = {}
    for t, x in zip(texts, langs, strict=True):
        own.setdefault(x, []).append(t)
    fill = np.zeros(len(names))
    for k, name in enumerate(names):
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for b in blocks(pa.array(own[name], pa.large_string())):
            h, d = ngrams(b)
            seen.append(np.unique(_distinct(h, d), return_counts=True))
        u, inv = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
        docs_with = np.bincount(inv, np.concatenate([x[1] for x in seen]), len(u))
        word, bit = slots[k // WORD_BITS], np.uint64(1 << k % WORD_BITS)
        for at in Filters.places(u[docs_with >= min(min_docs, max(1, len(own[name]) // 2))]):
            np.bitwise_or.at(word, at, bit)
        fill[k] = float(np.mean((word & bit) != 0)) ** HASHES
    counts = [len(own[n]) for n in names]
    return Filters(names, slots, fill, int(np.argmax(counts)) if counts else 0)


def _distinct(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new]


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Filters:
    """Filters from text and non-null lang of rows that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not sizes:
        return Filters([], np.zeros((1, SLOTS), np.uint64), np.zeros(0), 0)
    rows = max(1, min(rows, rows * WORD_BITS // len(sizes)))
    # a row for each language, of which the driver holds the filters too
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1_000_000, int(1_000_000 * rows / r["count"]))) for r in sizes], "lang string, rate int")
    drawn = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("rate"))
    drawn = drawn.select(F.xxhash64(F.lit(SALT), "doc_id").alias("place"), "doc_id", pieces(F.col("text"), F.col("doc_id"), TEXT_CHARS, PIECES, " ").alias("text"), "lang")
    got = drawn.orderBy("place", "doc_id", "text", "lang").limit(2 * rows * len(sizes)).toPandas()
    f = build(list(got["text"]), list(got["lang"]))
    top = sizes[0]["lang"]
    f.common = f.languages.index(top) if top in f.languages else f.common
    return f


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row's whole text."""
    names = np.array([*filters.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for b in blocks(batch.column(1)):
                best, score = filters.decide(b) if filters.languages else (np.zeros(b.n, int), np.zeros(b.n))
                und = ~letters[b.rows]
                yield pa.RecordBatch.from_arrays([batch.column(0)[b.rows], pa.array(names[np.where(und, len(names) - 1, best)], pa.string()), pa.array(np.where(und, 0.0, score))], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
