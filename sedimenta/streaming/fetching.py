"""URLs as a stream: each is asked for once, in all runs together, at each host's pace.

The source's offsets are Spark's (its checkpoint).  A micro-batch that is run again finds its answers:
those of a batch that was recorded in the table of answers, and those of a batch that was lost midway
in files, one for each answer.  Only what was on its way when a task died is asked for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sedimenta.sources.fetch import Answer, fetched
from sedimenta.sources.scratch import Log


def answers(spark: SparkSession, folder: str) -> Log:
    return Log(spark, f"{folder.rstrip('/')}/answers", "url string, body binary, error_kind string, message string, attempts int, batch long")


def follow(stream: DataFrame, folder: str, transport: Callable[[str], Answer], **options) -> StreamingQuery:
    """Asks for every new url of a stream of url until all that is there has been read; answers(spark, folder).load() has them."""
    log = answers(stream.sparkSession, folder)

    def run(batch: DataFrame, n: int) -> None:
        new = batch.select("url").where("url is not null").distinct().join(log.load().select("url"), "url", "left_anti")
        log.append(fetched(new, "url", transport, kept=f"{folder.rstrip('/')}/kept", **options).selectExpr("*", f"{n}L as batch"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
