"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is indexed, in the leaf that it descends to.  A
query walks the tree best-bin-first: a priority queue of branches ordered by distance to their
centres yields leaves, nearest first.  The number of leaves to visit is calibrated: calibration
queries are answered exactly, and visits widen until their neighbours are found to the wanted
recall.  Largest inner products become smallest distances by one more coordinate that lifts all
rows to the same norm.

Neighbouring leaves form regions, each compared by one task, which merges a query's leaves; a region
that many queries visit is compared by several tasks, each with a part of them.  The queue's first
leaves are compared first; the last score that a query needs of them is its floor.  Leaves visited
later are left out where their centre and radius show that no row reaches the floor, and of the
others only rows that reach it are returned.

Equal vectors: neighbours need the smallest ids of each distinct vector only, one more than the
rows asked for, so a vector that a third of all rows share does not fill a leaf; equal query
vectors are searched once.  Vectors that are null, zero, or hold null or non-finite components take
no part.  Vectors are compared with those of their own length only; each length has its own tree.
With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.tables import written

#: Rows on which the tree is fitted, at most; branches of a node; rows of a leaf, about.
SAMPLE, BRANCHES, LEAF_ROWS = 16_000, 8, 192
#: Rows of a region, about: neighbouring leaves that one task compares at once; larger leaves are split.
BLOCK_ROWS = 4096
#: Leaves of the queue that are compared before the others, for a floor.
FIRST_LEAVES = 8
#: Queries of a region that one task compares, about.
TASK_QUERIES = 2048
#: Calibration queries and the recall at which widening stops.
CALIBRATION, RECALL = 96, 0.97


@dataclass
class Tree:
    """Nodes as lists: centres of the children and their numbers; negative numbers are leaves."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def leaf_centres(self, width: int) -> np.ndarray:
        """The centre of each leaf; zero for a tree without branches."""
        out = np.zeros((max(1, self.leaves), width))
        for c, children in zip(self.centres, self.children, strict=True):
            for k, child in enumerate(children):
                if child < 0:
                    out[-child - 1] = c[k]
        return out

    def leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        stack = [(0 if self.children else -1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            c = self.centres[node]
            near = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), 1)
            stack += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves that the priority queue yields."""
        if not self.children:
            return [0]
        out: list[int] = []
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                continue
            d = ((self.centres[node] - q) ** 2).sum(1)
            for k, child in enumerate(self.children[node]):
                heapq.heappush(queue, (float(d[k]), child))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), 1)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
    return c, near


def fit(x: np.ndarray, leaf: int, seed: int = 1) -> Tree:
    """A tree whose leaves hold about leaf rows of x; one leaf if x is small."""
    rng, tree = np.random.default_rng(seed), Tree()

    def grow(rows: np.ndarray) -> int:
        if len(rows) <= max(leaf, BRANCHES):
            return tree.leaf()
        c, near = kmeans(x[rows], BRANCHES, rng)
        used = [j for j in range(BRANCHES) if (near == j).any()]
        if len(used) < 2:
            return tree.leaf()
        node = len(tree.children)
        tree.centres.append(c[used])
        tree.children.append([])
        tree.children[node] = [grow(rows[near == j]) for j in used]
        return node

    grow(np.arange(len(x)))
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest inner products of each query (row, id, score), ties to smaller ids.

    visited masks the rows that a query may return; rows below its floor are left out.  Products of
    a matrix routine choose; each score is then summed row by row, so equal vectors have equal
    scores.
    """
    rough = q @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max())
    if visited is not None:
        rough = np.where(visited, rough, -np.inf)
    cut = np.full(len(q), -np.inf) if floor is None else floor - slack
    if x.shape[0] > k:
        cut = np.maximum(cut, np.partition(rough, -k, axis=1)[:, -k] - slack)
    rows, cols = np.nonzero((rough >= cut[:, None]) & (rough > -np.inf))
    score = (q[rows] * x[cols]).sum(1)
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    start = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - start[rows] < k
    return rows[keep], ids[cols[keep]], score[keep]


def regions(held: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """First region and number of regions of each leaf; held: rows of each leaf.

    Leaves are numbered depth first, so those in a row share a subtree: they fill a region up to
    size rows.  A larger leaf has regions of its own.
    """
    out, at, room = {}, -1, 0
    for leaf, n in sorted(held.items()):
        if n > size:
            out[leaf] = (at + 1, math.ceil(n / size))
            at, room = at + out[leaf][1], 0
        else:
            if n > room:
                at, room = at + 1, size
            out[leaf], room = (at, 1), room - n
    return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec (array of doubles) of the rows that take part, and a digest of equal vectors."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda e: e != 0))
    return v.withColumn("digest", F.md5(F.array_join(F.transform("vec", lambda e: (e + 0.0).cast("string")), ",")))


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, sample: int = SAMPLE, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every row whose id is divisible by every."""
    spark = vectors.sparkSession
    table = written(usable(vectors), "vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda a, e: a + e * e)
    lengths = table.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.max(squares).alias("top")).orderBy("width").collect()  # a row for each length
    parts = [_search(table.where(F.size("vec") == r["width"]), r["width"], r["n"], r["top"], k, every, sample, recall, leaf_rows) for r in lengths]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(table: DataFrame, width: int, rows: int, top: float, k: int, every: int, sample: int, recall: float, leaf_rows: int) -> DataFrame:
    spark = table.sparkSession
    by_vector = Window.partitionBy("digest").orderBy("vec_id")
    candidates = table.withColumn("copy", F.row_number().over(by_vector)).where(F.col("copy") <= k + 1).drop("copy")
    queries = table.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec", "digest")
    heads = queries.withColumn("copy", F.row_number().over(by_vector)).where("copy = 1").select(F.col("vec_id").alias("head"), F.col("vec").alias("qvec"), "digest")

    draw = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "digest"), F.lit(1_000_000)) < min(1_000_000, math.ceil(1_000_000 * n / rows))
    got = candidates.where(draw(sample, 1)).orderBy("vec_id").limit(2 * sample).select("vec").toPandas()
    x = _lift(np.array(got["vec"].to_list(), np.float64), top) if len(got) else np.zeros((0, 1))
    tree = fit(x, max(BRANCHES, math.ceil(leaf_rows * len(x) / rows))) if len(x) else Tree(leaves=1)
    tree_ = spark.sparkContext.broadcast(tree)  # at most the sample's size

    centres = tree.leaf_centres(width + 1)[:, :width]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                leaf = tree_.value.descend(_lift(x, top))
                far = np.sqrt(((x - centres[leaf]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column(0), batch.column(1), pa.array(far)], ["leaf", "vec_id", "vec", "far"])

    index = written(candidates.select("vec_id", "vec").mapInArrow(place, "leaf long, vec_id long, vec array<double>, far double"), "index")
    visits = _calibrate(heads, index, tree, top, k, recall, draw)
    per_leaf = index.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each leaf
    radius = np.zeros(len(centres))
    radius[[r["leaf"] for r in per_leaf]] = [r["far"] for r in per_leaf]
    place_of = regions({r["leaf"]: r["n"] for r in per_leaf}, BLOCK_ROWS)
    where = spark.createDataFrame([(leaf, *r) for leaf, r in place_of.items()], "leaf long, start long, n long")
    dealt = index.join(where, "leaf").select((F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("n"))).alias("region"), "leaf", "vec_id", "vec")

    def walk(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, width))
                q, floor = _lift(x, 0.0), batch.column(2).to_numpy()
                norm = np.sqrt((x * x).sum(1))
                at, region, leaves = [], [], []
                for i in range(len(q)):
                    met: dict[int, list[int]] = {}
                    order = np.array(tree_.value.best_first(q[i], last)[first:], np.int64)
                    bound = centres[order] @ x[i] + norm[i] * radius[order]
                    for leaf in order[bound >= floor[i] - 1e-6 * (1 + abs(bound))].tolist():
                        start, n = place_of.get(leaf, (0, 0))
                        for r in range(start, start + n):
                            met.setdefault(r, []).append(leaf)
                    at += [i] * len(met)
                    region += met.keys()
                    leaves += met.values()
                part = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), part.column(0), part.column(1), part.column(2), pa.array(leaves, pa.list_(pa.int64()))], ["region", "head", "qvec", "floor", "leaves"])

        return run

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"head": [], "vec_id": [], "score": []})
        right = right.sort_values("vec_id")
        x, ids = np.stack(right["vec"]), right["vec_id"].to_numpy()
        q, heads_, floor = np.stack(left["qvec"]), left["head"].to_numpy(), left["floor"].to_numpy()
        names, leaf = np.unique(right["leaf"].to_numpy(), return_inverse=True)
        parts = []
        for s in range(0, len(q), 256):
            visited = np.zeros((len(q[s : s + 256]), len(names)), bool)
            for i, leaves in enumerate(left["leaves"].iloc[s : s + 256]):
                visited[i] = np.isin(names, leaves)
            r, i, v = best(q[s : s + 256], x, ids, k + 1, floor[s : s + 256], visited[:, leaf])
            parts.append(pd.DataFrame({"head": heads_[s + r], "vec_id": i, "score": v}))
        return pd.concat(parts)

    def visit(asked: DataFrame, first: int, last: int) -> DataFrame:
        asked = asked.select("head", "qvec", "floor").mapInArrow(walk(first, last), "region long, head long, qvec array<double>, floor double, leaves array<long>")
        asked = written(asked, f"asked{first}")
        parts = asked.groupBy("region").agg(F.ceil(F.count("*") / F.lit(TASK_QUERIES)).cast("int").alias("parts"))
        left = asked.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int")).drop("parts")
        right = dealt.join(parts, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return left.groupBy("region", "part").cogroup(right.groupBy("region", "part")).applyInPandas(compare, "head long, vec_id long, score double")

    by_head = Window.partitionBy("head").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("place", F.row_number().over(by_head)).where(F.col("place") <= k + 1)
    found = written(ranked(visit(heads.withColumn("floor", F.lit(float("-inf"))), 0, min(FIRST_LEAVES, visits))), "nearest")
    if visits > FIRST_LEAVES:
        floors = found.where(F.col("place") == k + 1).select("head", F.col("score").alias("floor"))
        asked = heads.join(floors, "head", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = ranked(found.drop("place").union(visit(asked, FIRST_LEAVES, visits)))
    found = found.drop("place")
    members = queries.select(F.col("vec_id").alias("query_id"), "digest").join(heads.select("head", F.col("digest").alias("head_digest")), F.col("digest") == F.col("head_digest")).select("query_id", "head")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = members.join(found, "head").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrate(heads: DataFrame, index: DataFrame, tree: Tree, top: float, k: int, recall: float, draw) -> int:
    """Leaves to visit: the least number that finds the wanted share of exact neighbours of the calibration queries."""
    if tree.leaves <= 1:
        return 1
    some = heads.where(draw(CALIBRATION * 20, 2)).orderBy("head").limit(CALIBRATION).toPandas()
    if not len(some):
        some = heads.orderBy("head").limit(CALIBRATION).toPandas()
    if not len(some):
        return tree.leaves
    q = np.array(some["qvec"].to_list(), np.float64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, leaf = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                r, i, v = best(q, _matrix(batch.column(2)), ids, k)
                leaf_of = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(v), pa.array([leaf_of[y] for y in i.tolist()], pa.int64())], ["q", "vec_id", "score", "leaf"])

    by_q = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    truth = index.mapInArrow(exact, "q long, vec_id long, score double, leaf long").withColumn("place", F.row_number().over(by_q)).where(F.col("place") <= k).collect()
    order = [{leaf: n for n, leaf in enumerate(tree.best_first(v, tree.leaves))} for v in _lift(q, 0.0)]
    need = np.sort([order[t["q"]].get(t["leaf"], tree.leaves) + 1 for t in truth])
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])
