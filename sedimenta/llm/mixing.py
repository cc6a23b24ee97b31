"""Mixing sources to target weights with a time-varying curriculum.

Every source has a weight schedule over training time [0, 1], a line through knots.  Its integral
is the source's demand, scaled to the target.  Documents of a source stand in a fixed pseudo-random
order; the running sum of their sizes is inverted through the cumulative demand, which gives each
document its training position, and the mix is range-sorted by position.

Targets: sources in order of code points (null last) weigh 5, 2, 1, repeating; together they take
``share`` of all sizes; a target stops at ``cap`` times its source's size and the excess is shared
anew by weight.  A source's documents are taken in whole passes, and once more in order until the
target is met, so taken words miss it by half a document at most.

Running sums are built from (source, bucket) sums, so a source with a third of all rows is spread
over many tasks; there may be any number of sources.  Null and empty texts have size 0 and are never taken.  Rows that repeat an id
are measured and taken each on its own.  An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.tables import Scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules by weight class: (time, weight) knots; only the shape counts.
SCHEDULES = ([(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.25), (0.5, 1.0), (1.0, 1.75)])
#: Seed of the pseudo-random order.
SEED = 11
#: A word: bytes other than space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def goals(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """mix_source, source_size, class and target of each source; sized(source, size).

    Sources are numbered by ranges of their names.  A common unit is raised until no target exceeds
    its cap; each step is one aggregation, so nothing but sums reaches the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = F.col("source").asc_nulls_last()
    per = scratch.write(per.repartitionByRange(by).withColumn("range", F.spark_partition_id()), "sources")
    before, start = 0, F.lit(0)
    for r in per.groupBy("range").count().orderBy("range").collect():  # a row for each partition
        start, before = F.when(F.col("range") == r["range"], before).otherwise(start), before + r["count"]
    number = start + F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    per = per.withColumn("class", F.pmod(number, F.lit(len(weights))).cast("int"))
    per = scratch.write(per.select(F.col("source").alias("mix_source"), "source_size", "class", F.element_at(F.lit([float(w) for w in weights]), F.col("class") + 1).alias("weight")), "classes")
    most = cap * F.col("source_size")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    unit, full = 0.0, -1
    while True:
        stop = most < F.lit(unit) * F.col("weight") if full >= 0 else F.lit(False)
        got = per.agg(F.count_if(stop).alias("full"), F.sum(F.when(stop, most)).alias("given"), F.sum(F.when(~stop, F.col("weight"))).alias("open")).first()
        if got["full"] == full:
            break
        full = got["full"]
        if not got["open"]:  # all stop at their caps
            unit = math.inf
            break
        unit = (share * total - (got["given"] or 0.0)) / got["open"]
    return per.select("mix_source", "source_size", "class", F.least(most, F.lit(unit) * F.col("weight")).alias("target"))


def segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(share of demand before, start time, weight at the start, slope) of each piece, demand scaled to 1."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, before, out = sum(area), 0.0, []
    for (a, b), x in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        out.append((before / total, a[0], a[1] / total, (b[1] - a[1]) / (b[0] - a[0]) / total))
        before += x
    return out


def key(seed: int) -> Column:
    """A row's place in the fixed pseudo-random order; rows of equal id and text share it."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def plan(docs: DataFrame, *, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """doc_id, u (the row's key), size, source, source_size, target, passes, extra, taken, position of each row, range-sorted by position.

    position is the training time of a document's first copy, null if none is taken.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.write(docs.select("doc_id", "source", n_words().alias("size"), key(seed).alias("u")), "sizes")
    want = goals(sized, scratch, weights, share, cap)
    want = want.withColumn("pieces", F.element_at(F.array(*(F.array(*(F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(p, ("lo", "t", "w", "slope"), strict=True))) for p in segments(s))) for s in schedules)), F.pmod("class", F.lit(len(schedules))) + 1))
    # as many buckets as a bucket has rows, about, so that neither running sum grows faster than the root of the rows
    buckets = max(1, math.isqrt(sized.count()))

    keyed = sized.withColumn("bucket", F.pmod(F.shiftright("u", 20), F.lit(buckets)))
    inside = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    placed = keyed.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    placed = placed.join(want, F.col("source").eqNullSafe(F.col("mix_source")))
    start = F.col("bucket_start") + F.col("inner_start")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("start", start).withColumn("passes", whole)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = ((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 < rest)).cast("long")
    placed = placed.withColumn("extra", extra).withColumn("taken", F.col("size") * (F.col("passes") + F.col("extra")))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, position(0)))
    out = placed.select("doc_id", "u", "size", "source", "source_size", "target", "passes", "extra", "taken", "position", "start", "pieces")
    return out.orderBy("position", "doc_id")


def position(copy: int | Column) -> Column:
    """The time at which cumulative demand reaches the middle of a document's copy, by solving a piece's quadratic."""
    copy = F.lit(copy) if isinstance(copy, int) else copy
    f = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target"))
    p = F.element_at(F.filter("pieces", lambda s: s["lo"] <= f), -1)
    need = f - p["lo"]
    return p["t"] + 2 * need / (p["w"] + F.sqrt(F.greatest(p["w"] * p["w"] + 2 * p["slope"] * need, F.lit(0.0))))


def mixed(docs: DataFrame, *, place: str | None = None, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: rows of docs with their columns, repeated as often as taken, range-sorted by position.

    place names a further column that holds each copy's position, as tables do not keep an order; it
    replaces a column of that name.  Other columns may have any names: rows travel whole in one column.
    Rows that repeat an id and a text get the first of their plans.
    """
    p = plan(docs, seed=seed, **options).where("taken > 0").withColumn("copies", F.col("passes") + F.col("extra"))
    copies = p.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).withColumn("at", position(F.col("copy")))
    copies = copies.groupBy(F.col("doc_id").alias("mix_id"), F.col("u").alias("mix_u"), "copy").agg(F.min("at").alias("at"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key(seed).alias("u"))
    out = rows.join(copies, (F.col("u") == F.col("mix_u")) & F.col("row.doc_id").eqNullSafe(F.col("mix_id"))).orderBy("at", "mix_id", "u")
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != place), *([F.col("at").alias(place)] if place else []))
