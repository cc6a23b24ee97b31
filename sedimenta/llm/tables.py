"""Reading tables and shared folders, for the queries of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.blocks import BATCH_ROWS

#: Least and most 64-bit words of a bitmap of points.
BITMAP_WORDS = 1 << 10, 1 << 20

_I = np.int64


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python workers of this session get documents in batches of BATCH_ROWS; queries call it before they plan."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    spark.checkpoint.dir names it.  Where that is unset, as in tests, a session whose executors are
    threads of the driver gets a local one; any other is refused, as its executors have other disks.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", top)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and lost executors don't lose it."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables of one run in the shared folder, by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, shared_folder(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables whose last reader is done, and the shuffles of stages that are over.

        Spark deletes a shuffle's files when the driver's collector meets its handle, which on a
        large heap can be hours after the last use; so the collector is called here.
        """
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}-{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def bitmap(points: DataFrame, about: int) -> np.ndarray:
    """A bitmap with a bit for each value of the column point; bits may be shared.

    about is the number of values expected; the size follows it between fixed bounds.  A full bitmap
    lets more through, and loses nothing.
    """
    words = min(max(1 << math.ceil(math.log2(max(1, about / 4))), BITMAP_WORDS[0]), BITMAP_WORDS[1])
    word = F.shiftright("point", 6).bitwiseAND(F.lit(words - 1)).alias("w")
    mask = F.expr("shiftleft(1L, cast(point & 63 as int))").alias("m")
    got = points.select(word, mask).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(words, _I)
    out[got["w"].to_numpy(_I)] = got["m"].to_numpy(_I)
    return out


def marked(bits: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((bits[(points >> 6) & (len(bits) - 1)] >> (points & 63)) & 1) != 0


def pieces(text: Column, key: Column, chars: int, n: int, between: str = "\n") -> Column:
    """A text to learn from: the whole one, or, where it is longer than chars, n pieces of it with chars characters in all.

    Each piece lies in its own nth of the text, at a place drawn by a hash of key, so that every part
    of a long text can be learned from, and the same ones in each run.
    """
    length, width = F.char_length(text), chars // n
    share = F.floor(length / n)
    at = lambda k: k * share + F.pmod(F.xxhash64(key, k), F.greatest(share - width + 1, F.lit(1)))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(text, (at(k) + 1).cast("int"), F.lit(width)))
    return F.when(length > chars, F.array_join(drawn, between)).otherwise(text)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
