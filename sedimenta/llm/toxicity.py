"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a probability from a logistic model of its
hashed words and word beginnings; in learning, a document's probability is the noisy-or of its
sentences, the chance that at least one is toxic.  Only documents carry labels: the gradient of the
noisy-or likelihood reaches the sentences that explain a label, so the model also locates them.

A plain noisy-or grows with length, as chance hits of clean sentences add up.  A score is therefore
the noisy-or of the run of sentences that stands out most above a background rate, less what the
most conspicuous run of clean text gains by length; both are learned from folds held out in turn.

Texts that are null or have no word have no sentence and score 0.  Repeated rows score alike.  An id
with several labels has the largest.
Without labels of both kinds the model scores every text 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.blocks import Block, blocks, mix
from sedimenta.llm.tables import pieces, remainder

#: Weights of the model (hash buckets).
BUCKETS = 1 << 18
#: Labelled documents from which the model is learned, at most, their bytes, and characters taken of one text, in as many pieces where it is longer.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT, PIECES = 8_000, 10_000_000, 1_000_000, 50
#: Folds that calibrate the background, and what the score of clean text of any length should stay below.
FOLDS, CLEAN = 3, 0.2
#: Salt of the hash that orders them.
SALT = 11
#: Lengths of word beginnings used as features, in bytes.
STARTS = (4, 5, 6)
#: Bytes that belong to no word, and those that end a sentence.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True


@dataclass
class Bags:
    """Sentences of some documents with their distinct features."""

    cell: np.ndarray  # feature of each entry
    sentence: np.ndarray  # sentence of each entry
    doc: np.ndarray  # document of each sentence
    start: np.ndarray  # first and last byte of each sentence's words
    end: np.ndarray


def bags(b: Block) -> Bags:
    s, e, d = b.spans(LETTER[b.data])
    if not len(s):
        z = np.zeros(0, np.int64)
        return Bags(z, z, z, z, z)
    stops = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(STOP[b.data], out=stops[1:])
    part = stops[s]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (d[1:] != d[:-1])])
    sent = np.cumsum(new) - 1
    h = [b.hashes(s, e, lower=True)]
    of = [sent]
    for k in STARTS:
        long = e - s >= k
        h.append(mix(b.hashes(s[long], s[long] + k, lower=True) + np.uint64(k)))
        of.append(sent[long])
    h, of = np.concatenate(h), np.concatenate(of)
    key = ((h & np.uint64(BUCKETS - 1)) << np.uint64(40)) | of.astype(np.uint64)
    key = np.unique(key)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    return Bags((key >> np.uint64(40)).astype(np.int32), (key & np.uint64((1 << 40) - 1)).astype(np.int32), d[first], s[first], e[last])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    rate: float = 0.0  # background of a sentence
    slope: float = 0.0  # what clean text gains for each e-fold of length
    usual: float = 1.0  # sentences up to which nothing is gained

    def sentences(self, x: Bags) -> np.ndarray:
        z = self.bias + np.bincount(x.sentence, self.weights[x.cell], len(x.doc))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def documents(self, x: Bags, n: int, p: np.ndarray | None = None) -> np.ndarray:
        p = self.sentences(x) if p is None else p
        h = -np.log1p(-np.minimum(p, 1 - 1e-12))
        if not self.rate:
            return -np.expm1(-np.bincount(x.doc, h, n))
        gain = self.slope * np.log(np.maximum(np.bincount(x.doc, minlength=n) / self.usual, 1))
        return -np.expm1(-np.maximum(peaks(h - self.rate, x.doc, n) - gain, 0))


def peaks(excess: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The largest sum of consecutive sentences of each document, 0 at least."""
    out = np.zeros(n)
    if len(doc):
        c = np.cumsum(excess)
        before = np.concatenate([[0.0], c[:-1]])
        # documents are put one below the other, so that the running minimum starts anew with each
        shift = doc * (np.abs(excess).sum() + 1)
        np.maximum.at(out, doc, c - shift - np.minimum.accumulate(before - shift))
    return out


def train(texts: list[bytes], y: np.ndarray, *, rounds: int = 15, rate: float = 0.3, shrink: float = 0.02, start: float = -8.0, seed: int = 3, min_docs: int = 6, boost: float = 1.0) -> Model:
    """Adaptive gradient descent on the noisy-or likelihood, in shuffled blocks of documents.

    Features of fewer than min_docs documents stay out; weights shrink towards zero (soft
    thresholding in each feature's own step size), which leaves chance features at zero.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    column = pa.array([texts[k] for k in order], pa.large_binary()).cast(pa.large_string())
    y = y[order]
    parts = [(bags(b), y[b.rows]) for b in blocks(column, 1 << 19)]
    docs_with = np.zeros(BUCKETS, np.int64)
    for x, _ in parts:
        pair = np.unique(x.doc[x.sentence].astype(np.int64) * BUCKETS + x.cell) if len(x.cell) else np.zeros(0, np.int64)
        docs_with += np.bincount(pair % BUCKETS, minlength=BUCKETS)
    for x, _ in parts:
        use = docs_with[x.cell] >= min_docs
        x.cell, x.sentence = x.cell[use], x.sentence[use]
    model = Model(np.zeros(BUCKETS), start)
    seen, seen_bias = np.full(BUCKETS, 1e-4), 1e-2
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -30.0)
    even = (len(y) - y.sum()) / y.sum()
    for _ in range(rounds):
        for k in rng.permutation(len(parts)):
            x, t = parts[k]
            p = model.sentences(x)
            doc = np.clip(model.documents(x, len(t), p), 1e-9, 1 - 1e-9)
            g = np.where(t > 0, -min(even, boost) * (1 - doc) / doc, 1.0)[x.doc] * p
            gw = np.bincount(x.cell, g[x.sentence], BUCKETS)
            hit = np.flatnonzero(gw)
            gw = gw[hit]
            seen[hit] += gw * gw
            step = rate / np.sqrt(seen[hit])
            w = model.weights[hit] - step * gw
            model.weights[hit] = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
            gb = g.sum() / 50
            seen_bias += gb * gb
            model.bias -= 0.1 * rate * gb / np.sqrt(seen_bias)
    return model


def calibrated(texts: list[bytes], y: np.ndarray, *, folds: int = FOLDS, seed: int = 4) -> Model:
    """The model of all texts, its background learned from texts that each fold's model has not seen.

    The rate lies between those of clean and toxic texts, where a running sum tells them apart
    soonest.  The slope keeps clean texts, joined to lengths up to all of them, below CLEAN.
    """
    model = train(texts, y)
    hazard = np.log1p(np.exp(model.bias))
    model.rate = 2 * float(hazard)
    fold = np.random.default_rng(seed).permutation(len(texts)) % folds
    parts: dict[bool, list[np.ndarray]] = {False: [], True: []}
    for k in range(folds):
        a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(b) or y[a].min(initial=1) == y[a].max(initial=0):
            continue
        part = train([texts[i] for i in a], y[a])
        for toxic in (False, True):
            column = pa.array([texts[i] for i in b if (y[i] > 0) == toxic], pa.large_binary()).cast(pa.large_string())
            for x in map(bags, blocks(column, 1 << 19)):
                h = -np.log1p(-np.minimum(part.sentences(x), 1 - 1e-12))
                parts[toxic] += np.split(h, np.flatnonzero(np.diff(x.doc)) + 1) if len(h) else []
    if not parts[False] or not parts[True]:
        return model
    clean, toxic = np.concatenate(parts[False]), np.concatenate(parts[True])
    low, high = clean.mean(), toxic.mean()
    if high > low > 0:
        model.rate = max(model.rate, float((high - low) / np.log(high / low)))
    model.usual = max(1.0, len(clean) / len(parts[False]))
    length = 16 * model.usual
    while length <= len(clean):
        joined = (np.arange(len(clean)) // length).astype(np.int64)
        most = peaks(clean - model.rate, joined, joined[-1] + 1).max()
        model.slope = max(model.slope, float((most + np.log1p(-CLEAN)) / np.log(length / model.usual)))
        length *= 2
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """A model from labels(doc_id, toxic): a hash sample of about rows labelled documents and size bytes.

    Rows that are held out (crc32 of the id as text, modulo 4, is 2) are never used.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), "toxic").where(F.col("toxic").isNotNull() & (remainder() != 2))
    known = known.where("label_id is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return Model(np.zeros(BUCKETS), -30.0)
    keep = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * rows / n))
    sample = docs.select("doc_id", "text").where(keep("doc_id") & F.col("text").isNotNull()).join(known.where(keep("label_id")), F.col("doc_id") == F.col("label_id"))
    # of the longest texts pieces from all over are learned from; scoring always sees the whole
    sample = sample.select("doc_id", F.xxhash64(F.lit(SALT), "doc_id").alias("place"), pieces(F.col("text"), F.col("doc_id"), TRAIN_TEXT, PIECES).alias("text"), "toxic")
    # sizes first: the bytes are met by a lower rate of the hash, whatever the order of the ids
    sizes = sample.select("place", F.octet_length("text").alias("size")).orderBy("place").limit(2 * rows).toPandas()
    use = int((sizes["size"].cumsum() <= size).sum())
    if not use:
        return Model(np.zeros(BUCKETS), -30.0)
    got = sample.where(F.col("place") <= F.lit(int(sizes["place"].iloc[use - 1]))).orderBy("place", "doc_id", "text").limit(use).select("text", "toxic").toPandas()
    return calibrated([t.encode() for t in got["text"]], (got["toxic"].to_numpy() > 0).astype(float))


def _scores(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1)):
            x = bags(b)
            p = model.sentences(x)
            worst = np.full(b.n, -1, np.int64)
            order = np.argsort(p, kind="stable")
            worst[x.doc[order]] = order  # the last write, that of the highest, stays
            has = worst >= 0
            at, to = np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
            at[has] = x.start[worst[has]] - b.offs[:-1][has]
            to[has] = x.end[worst[has]] - b.offs[:-1][has]
            out = [pa.array(model.documents(x, b.n, p)), pa.array(np.where(has, p[worst] if len(p) else 0.0, 0.0)), pa.array(at), pa.array(to)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[b.rows], *out], ["doc_id", "score", "sentence_score", "sentence_start", "sentence_end"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the score and byte range of the worst sentence of each row."""
    small = Model(model.weights.astype(np.float32), model.bias, model.rate, model.slope, model.usual)
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _scores(small, it), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, sentence_score double, sentence_start long, sentence_end long"
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(at)):
                p = model.documents(bags(b), b.n)
                part = batch.slice(b.first, b.n).filter(pa.array(p < threshold))
                if part.num_rows:
                    yield part

    return docs.mapInArrow(clean, docs.schema)
