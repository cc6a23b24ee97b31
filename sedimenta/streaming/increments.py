"""Filings as a stream: each micro-batch is planned against the published subscriptions and committed.

The baseline moves by committed success and not by the arrival of data, so it is state of its own
(sources.state) and no watermark.  What was taken is recorded before the state is published, in a
table of its own: a micro-batch that is run again, because it failed in between, takes only the rest.
(What fails inside take itself is take's own: it gets the same filings again.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.operators import updates
from sedimenta.sources.scratch import Log
from sedimenta.sources.state import Versions


def taken_log(spark: SparkSession, folder: str) -> Log:
    """The table of filings that were taken."""
    return Log(spark, folder, "cik string, accn string, batch long")


def step(filings: DataFrame, subs: Versions, take: Callable[[DataFrame], DataFrame], taken: Log | None = None, batch: int = 0, **options) -> DataFrame:
    """One increment: plans filings, lets take(new) do the work, publishes what it returns as done(cik, accn); returns the updates.

    taken: where the work done is recorded before the publication; what it holds is not given to take.
    """
    now = subs.load()
    new, ups = updates.plan(updates.normalized(filings), now, **options)
    new, ups = new.cache(), ups.cache()
    try:
        if taken is None:
            done = take(new)
        else:
            known = taken.load().select("cik", "accn")
            done = take(new.join(known, ["cik", "accn"], "left_anti"))
            fresh = taken.append(done.select("cik", "accn", F.lit(batch).cast("long").alias("batch")))
            done = fresh.select("cik", "accn").union(new.select("cik", "accn").join(known, ["cik", "accn"], "left_semi")).distinct()
        out = updates.record_seen(now, new, ups, done)
        fault = subs.publish(out, lambda x: "rows were lost" if x.count() != now.count() else None)
        if fault:
            raise RuntimeError(fault)
        return ups
    finally:
        new.unpersist()


def follow(stream: DataFrame, subs: Versions, take: Callable[[DataFrame], DataFrame], checkpoint: str, **options) -> StreamingQuery:
    """Runs step on every micro-batch of a stream of filings until all that is there has been read."""

    taken = taken_log(stream.sparkSession, f"{checkpoint.rstrip('/')}-taken")

    def run(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            step(batch, subs, take, taken, n, **options).unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
