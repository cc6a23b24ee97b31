"""Connected components by alternating large and small stars, as shuffles of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tables import Scratch


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of edges(u, v) but the roots themselves.

    Every round hangs nodes on smaller neighbours; depth falls geometrically.  Rounds go on until the
    edges no longer change.  No edges give no rows.
    """
    scratch, turn = Scratch(edges.sparkSession), 0
    e = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    before = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = scratch.write(small.where("u <> v").distinct(), f"edges{turn + 1}")
        scratch.drop(f"edges{turn}")
        turn += 1
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
