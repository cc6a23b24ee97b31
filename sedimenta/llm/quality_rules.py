"""Quality rules as learned decision lists.

Statistics of each whole text (word counts, symbols, repeated lines and words, letter case) are
computed block-wise.  Sequential covering then learns an ordered list of rules from labelled
statistics: a conjunction of thresholds is grown on two thirds of the labelled rows by information
gain, pruned on the other third, accepted if it is precise there, and the rows that it covers
leave both parts.  An id with several labels has the least; learning sees rows in a fixed order.  The list is emitted as one Spark conditional expression.

Null and empty texts have zero words, so the base rule fails them.  Repeated rows are judged alike
and each returned; a null label teaches nothing; without labels the list is empty and only the
base rule speaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.blocks import SPACE, blocks, grams, repeated, with_doc

#: Labelled rows from which a list is learned, at most (a sample by hash of the id).
LABEL_ROWS = 20_000
#: Salt of the hash that orders them.
SALT = 1
#: The symbols that n_symbols counts.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: Features that conditions may test.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "bar_share", "digit_share", "unique_share", "line_words"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] < self.value

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.value) if self.above else c < F.lit(self.value)


def _block(b) -> dict[str, np.ndarray]:
    starts, ends, doc = b.words()
    count = lambda d, size=b.n: np.bincount(d, minlength=size)
    n_words = count(doc)
    solid = ~SPACE[b.data]
    word_chars = b.per_doc(solid & _HEAD[b.data])
    n_symbols = b.per_doc(_SYMBOL[b.data])
    a, z, line_doc = b.lines()
    has = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(solid, out=has[1:])
    full = has[z] > has[a]
    a, z, line_doc = a[full], z[full], line_doc[full]
    later = repeated(with_doc(b.hashes(a, z), line_doc))[1]
    word = b.hashes(starts, ends)
    three, at = grams(word, doc, 3)
    again = repeated(with_doc(three, doc[at]))[0]
    mark = np.zeros(len(word), bool)
    for k in range(3):
        mark[at[again] + k] = True
    new_word = ~repeated(with_doc(word, doc))[1]
    n_lines = count(line_doc)
    upper = b.per_doc((b.data >= 65) & (b.data <= 90))
    lower = b.per_doc((b.data >= 97) & (b.data <= 122))
    n_repeat = count(doc[mark])
    n_dup = count(line_doc[later])
    share = lambda x, y: x / np.maximum(y, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "mean_word": share(word_chars, n_words), "symbol_share": share(n_symbols, n_words), "dup_line_share": share(n_dup, n_lines),
        "repeat_share": share(n_repeat, n_words), "upper_share": share(upper, upper + lower), "bang_share": share(b.per_doc(b.data == 33), n_words),
        "bar_share": share(b.per_doc(b.data == 124), n_words), "digit_share": share(b.per_doc((b.data >= 48) & (b.data <= 57)), word_chars),
        "unique_share": share(count(doc[new_word]), n_words), "line_words": share(n_words, n_lines),
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*COUNTS, *(x for x in FEATURES if x not in COUNTS)]
    for batch in batches:
        for b in blocks(batch.column(1)):
            got = _block(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[b.rows], *(pa.array(got[x], pa.int64() if x in COUNTS else pa.float64()) for x in names)], ["doc_id", *names]
            )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with COUNTS and FEATURES of each row's whole text."""
    extra = ", ".join(f"{x} double" for x in FEATURES if x not in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(_stats, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{x} long' for x in COUNTS)}, {extra}")


def _gain(pos: np.ndarray, neg: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained over positives that stay covered."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - np.log2(p0 / (p0 + n0))), 0.0)


def grow(x: dict[str, np.ndarray], y: np.ndarray, features: list[str], depth: int, cuts: int) -> list[Condition]:
    """One conjunction, a condition at a time; thresholds are quantiles of the rows still covered."""
    rule: list[Condition] = []
    cover = np.ones(len(y), bool)
    while len(rule) < depth and y[cover].any() and not y[cover].all():
        best: tuple[float, Condition | None] = (1e-9, None)
        p0, n0 = int(y[cover].sum()), int((~y[cover]).sum())
        for f in features:
            v, t = x[f][cover], y[cover]
            values = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)), np.quantile(v[t], np.linspace(0, 1, cuts))]))
            order = np.sort(v[t]), np.sort(v[~t])
            below = [np.searchsorted(o, values, "left") for o in order]
            for above in (True, False):
                pos, neg = (p0 - below[0], n0 - below[1]) if above else below
                g = _gain(pos.astype(float), neg.astype(float), p0, n0)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), Condition(f, above, float(values[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        cover &= best[1].mask(x)
    return rule


def covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for c in rule:
        m &= c.mask(x)
    return m


def prune(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """Drops final conditions while (p - n) / (p + n) on the pruning rows does not fall."""

    def worth(r: list[Condition]) -> float:
        m = covered(r, x, len(y))
        p, n = int((m & y).sum()), int((m & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, features: list[str] = FEATURES, rules: int = 16, depth: int = 4, cuts: int = 48, precision: float = 0.95, seed: int = 7) -> list[list[Condition]]:
    """The ordered rules that reject rows, learned by sequential covering."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(bad)) < 1 / 3
    cut = lambda m: ({f: x[f][m] for f in features}, bad[m])
    (gx, gy), (px, py) = cut(~held), cut(held)
    out: list[list[Condition]] = []
    while len(out) < rules and gy.sum() >= 5:
        rule = grow(gx, gy, features, depth, cuts)
        if not rule:
            break
        rule = prune(rule, px, py)
        m, g = covered(rule, px, len(py)), covered(rule, gx, len(gy))
        hits = int((m & py).sum()) + int((g & gy).sum())
        misses = int((m & ~py).sum()) + int((g & ~gy).sum())
        if hits < 5 or hits < precision * (hits + misses) or int((m & py).sum()) < precision * int(m.sum()):
            break
        out.append(rule)
        gx, gy = {f: v[~g] for f, v in gx.items()}, gy[~g]
        px, py = {f: v[~m] for f, v in px.items()}, py[~m]
    return out


def decision(rules: list[list[Condition]]) -> Column:
    """The list as a conditional expression: the number of the first rule that fits, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def learn_from(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> list[list[Condition]]:
    """Rules from labels(doc_id, quality), quality 0 being bad; a hash sample of about rows labels is used."""
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null")
    n = known.count()
    if not n:
        return []
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * rows / n))
    known = known.where(keep).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    got = statistics(docs.select("doc_id", "text").where(keep)).join(known, F.col("doc_id") == F.col("label_id")).orderBy(F.xxhash64(F.lit(SALT), "doc_id"), "doc_id", *COUNTS, *FEATURES).limit(2 * rows).toPandas()
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, (got["quality"] == 0).to_numpy()) if len(got) else []


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed, rule (number of the rejecting rule) and kept, one row per document."""
    rules = learn_from(docs, labels)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).withColumns({"base_failed": base, "rule": decision(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
