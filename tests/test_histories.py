"""Translation states over sequences of events: tables and streams against a plain loop, in any order, with repeats, gaps and restarts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sedimenta.operators.histories import Event, State, histories, step

EVENTS = "cik string, accn string, event_no long, event string, fingerprint string, output_hash string, found_hash string, message string"
RECORDS = "cik string, accn string, status string, fingerprint string, output_hash string, last_error string, event_no long, k long, outcome string"


def _events(seed, records=40):
    rng, out = random.Random(seed), []
    for r in range(records):
        for no in range(1, rng.randint(0, 9) + 1):
            kind = rng.choice(["start", "start", "stop", "built", "published", "built", "published", "other", None])
            out.append((f"{r % 7}", f"a{r}", no, kind, rng.choice("fg"), rng.choice("hi"), rng.choice([None, None, "h", "i"]), rng.choice(["Limit reached", "cancelled", "broken", None])))
    return out


def _expected(records, events):
    out = {}
    for cik, accn, *state, before, _, _ in records:
        s, last = State(*state), before or 0
        own = {}
        for e in sorted((e for e in events if e[:2] == (cik, accn) and e[2] is not None and e[2] >= 1), key=lambda e: tuple((v is not None, v or "") for v in e[3:])):
            own.setdefault(e[2], Event(*e[3:]))
        while last + 1 in own:
            last += 1
            s = step(s, own[last])
        out[cik, accn] = (*s, last, sum(no > last for no in own))
    return out


def _records(records=40, extra=()):
    return [(f"{r % 7}", f"a{r}", ["pending", "complete", "publishing", "translating"][r % 4], "f", "h", None, None if r % 3 else 0, r, "old") for r in range(records)] + list(extra)


@pytest.mark.parametrize("seed", range(4))
def test_tables(spark, seed):
    rng = random.Random(seed)
    events = _events(seed)
    events += rng.sample(events, 30) + [("9", "none", 1, "start", "f", None, None, None), ("0", "a0", None, "start", "f", None, None, None), ("0", "a0", 0, "start", "f", None, None, None)]
    gone = set(rng.sample(range(len(events)), 25))
    events = [e for k, e in enumerate(events) if k not in gone]
    rng.shuffle(events)
    records = _records()
    got = histories(spark.createDataFrame(records, RECORDS), spark.createDataFrame(events, EVENTS))
    rows = got.collect()
    assert len(rows) == len(records) and {(r["cik"], r["accn"]): r["k"] for r in rows} == {r[:2]: r[7] for r in records}
    assert {(r["cik"], r["accn"]): (r["status"], r["fingerprint"], r["output_hash"], r["last_error"], r["outcome"], r["event_no"], r["n_held"]) for r in rows} == _expected(records, events)
    # what is left of the numbers is applied by a later run, and nothing twice
    again = {(r["cik"], r["accn"]): (r["status"], r["event_no"]) for r in histories(got, spark.createDataFrame(events, EVENTS)).collect()}
    assert again == {k: (v[0], v[5]) for k, v in _expected(records, events).items()}


def test_two_events_give_one_row(spark):
    from sedimenta.operators import library

    records = spark.createDataFrame([("1", "a", "pending", "f", None, None)], "cik string, accn string, status string, fingerprint string, output_hash string, last_error string")
    events = spark.createDataFrame([("1", "a", 1, "start", "f", None, None, None), ("1", "a", 2, "built", None, "h", None, None)], EVENTS)
    assert [(r["status"], r["output_hash"]) for r in histories(records, events).collect()] == [("publishing", "h")]
    with pytest.raises(Exception, match="several events"):
        library.translation_step(records, events).collect()
    assert histories(records.where("false"), events).count() == 0 and histories(records, events.where("false")).first()["status"] == "pending"


def test_a_record_with_very_many_events(spark):
    events = spark.range(1, 60_001).select(F.lit("1").alias("cik"), F.lit("a").alias("accn"), F.col("id").alias("event_no"), F.element_at(F.array(*map(F.lit, ["start", "stop"])), (F.col("id") % 2 + 1).cast("int")).alias("event"), *(F.lit(None).cast("string").alias(c) for c in ("fingerprint", "output_hash", "found_hash")), F.lit("x").alias("message"))
    records = spark.createDataFrame([("1", "a", "pending", None, None, None)], "cik string, accn string, status string, fingerprint string, output_hash string, last_error string")
    assert [(r["status"], r["event_no"]) for r in histories(records, events.orderBy(F.rand(1))).collect()] == [("translating", 60_000)]


def test_stream_with_restarts(spark, tmp_path):
    """The same events in six files, in another order, some in two files; the query is stopped and started again between them."""
    from sedimenta.streaming import histories as stream

    stream.prepared(spark)
    rng, events, records = random.Random(8), _events(8, 12), _records(12)
    gone = rng.sample(range(len(events)), 4)
    kept = [e for k, e in enumerate(events) if k not in gone] + rng.sample(events, 5)
    kept = [e for e in kept if e not in [events[k] for k in gone]]
    rng.shuffle(kept)
    start = spark.createDataFrame([r[:7] for r in records], RECORDS.rsplit(", ", 2)[0])

    def run(part, n):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        q = stream.histories(source, start).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda df, k: df.withColumn("at", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).start().awaitTermination()

    parts = [kept[k::3] for k in range(3)]
    for n, part in enumerate([*parts, [events[k] for k in gone]]):
        run(part, n)
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("cik", "accn").agg(F.max_by(F.struct("status", "fingerprint", "output_hash", "last_error", "outcome", "event_no", "n_held"), "at").alias("s")).collect()
    want = _expected(records, events)
    assert {(r["cik"], r["accn"]): tuple(r["s"]) for r in rows} == {k: v for k, v in want.items() if any(e[:2] == k for e in events)}


def test_each_order_of_a_short_history_ends_alike(spark):
    """All orders of four events, each as a record of its own."""
    base = [(1, "start", "f", None, None, None), (2, "built", None, "h", None, None), (3, "published", None, None, None, None), (4, "start", "f", None, "h", None)]
    rows = [("1", f"{k}", *e) for k, p in enumerate(itertools.permutations(base)) for e in p]
    records = spark.createDataFrame([("1", f"{k}", "pending", None, None, None) for k in range(24)], "cik string, accn string, status string, fingerprint string, output_hash string, last_error string")
    got = histories(records, spark.createDataFrame(rows, EVENTS))
    assert {(r["status"], r["outcome"], r["event_no"], r["n_held"]) for r in got.collect()} == {("complete", "reused", 4, 0)} and got.count() == 24
