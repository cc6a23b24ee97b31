"""Cleaning that executes: digests of inventories, a token that works once, and a journal that is replayed after a crash.

A digest does not depend on order: it is the number of entries and two sums of keyed 64-bit hashes, so
it aggregates in part, wherever rows lie, and digests of folders add up to those of the folders above.
It finds changes; it does not withstand someone who seeks collisions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.sources.scratch import Log, created, names, put, written

#: Keys of the two hashes.
KEYS = ("inventory-1", "inventory-2")


def digest(*columns: str | Column) -> Column:
    """An aggregate: a digest of the multiset of rows, nulls and texts apart."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    line = F.to_json(F.struct(*(F.coalesce(c.cast("string"), F.lit("\0")).alias(f"c{k}") for k, c in enumerate(cols))))
    # sums of 64-bit numbers fit a decimal of 38 digits for 1e19 rows
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), line).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for k in KEYS]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)


def folders(inventory: DataFrame) -> DataFrame:
    """folder, n, n_bytes and digest of everything below each folder of inventory(path, mode, size, sha256)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = inventory.where(F.size(parts) > 1).select(F.explode(above).alias("folder"), "path", "mode", "size", "sha256")
    return each.groupBy("folder").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), digest("path", "mode", "size", "sha256").alias("digest"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The folders whose digests differ between two results of folders(), lowest ones only."""
    a, b = before.select("folder", F.col("digest").alias("a")), after.select("folder", F.col("digest").alias("b"))
    out = a.join(b, "folder", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("folder")
    upper = out.select(F.regexp_extract("folder", "^(.*)/[^/]*$", 1).alias("folder"))
    return out.join(upper, "folder", "left_anti")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name, the place of each row in a global order from 1: rows are dealt by ranges and numbered in each."""
    parts = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    start, before = F.lit(0), 0
    for r in parts.groupBy("_range").count().orderBy("_range").collect():  # a row for each partition
        start, before = F.when(F.col("_range") == r["_range"], before).otherwise(start), before + r["count"]
    place = start + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn(name, place.cast("int")).drop("_range")


class Cleaning:
    """One execution of a cleaning plan, in a folder that driver and executors share.

    A plan is made anew and must have the signature that was confirmed; a signature is a token that
    works once.  The plan is written to a journal before anything is deleted.  Files go in order of
    their rank (states and sources last), all of one rank before the next; what is gone is noted file
    by file.  After a crash, resume() goes on from the journal with what is not noted.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.journal = Log(spark, f"{self.folder}/journal", "path string, place long, rank int, size long, sha256 string")

    def execute(self, confirmed: str, replan: Callable[[], tuple[DataFrame, DataFrame]], rank: Callable[[Column], Column], delete: Callable[[str], None]) -> str | None:
        """Deletes what the confirmed plan names; returns why it is refused: the plan's own error, changed, or used.

        replan gives (plan(path, place, size, sha256), one row with error and signature), as cleaning_plan does.
        """
        if names(f"{self.folder}/journal/_commits"):
            return "used"
        plan, one = replan()
        plan = written(plan.select("path", "place", rank(F.col("path")).alias("rank"), "size", "sha256"), "plan")
        now = one.first()
        if now["error"]:
            return now["error"]
        if now["signature"] != confirmed:
            return "changed"
        if not created(f"{self.folder}/tokens", confirmed):
            return "used"
        self.journal.append(plan)
        self.resume(delete)
        return None

    def resume(self, delete: Callable[[str], None]) -> None:
        """Deletes what the journal names and nothing notes yet; without a journal there is nothing to do."""
        if not names(f"{self.folder}/journal/_commits"):
            return
        gone = f"{self.folder}/gone"
        rows = self.journal.load()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    delete(path)
                    put(gone, f"{hashlib.sha256(path.encode()).hexdigest()}.json", json.dumps({"path": path}).encode())
            yield from ()

        for r in sorted(x["rank"] for x in rows.select("rank").distinct().collect()):  # a handful of ranks
            left = rows.where(F.col("rank") == r).join(self.gone(), "path", "left_anti")
            left.select("path").repartition("path").mapInArrow(run, "x int").write.format("noop").mode("overwrite").save()

    def gone(self) -> DataFrame:
        """The paths that were deleted."""
        some = names(f"{self.folder}/gone")
        return self.spark.read.schema("path string").json(f"{self.folder}/gone") if some else self.spark.createDataFrame([], "path string")
