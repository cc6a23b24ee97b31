"""What a record's events make of it: a state machine over ordered sequences, the same for tables and for streams.

Events of a record carry numbers from 1 on.  They may arrive in any order and more than once: each
number counts once, and what comes after a gap is held until the gap is filled.  So every order of
arrival leads to the same state, and what was applied before a restart is not applied again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons for which a translation is paused, to go on later; others are failures.
PAUSES = re.compile("cancel|limit|cache only")
#: Columns of a record's state, and of an event besides its record and number.
STATE = "status string, fingerprint string, output_hash string, last_error string, outcome string, event_no long, n_held long"
EVENT = "event string, fingerprint string, output_hash string, found_hash string, message string"
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 10_000


class State(NamedTuple):
    status: str | None = "pending"
    fingerprint: str | None = None
    output_hash: str | None = None
    last_error: str | None = None
    #: What the last start came to: reused, refused, or null where it began.
    outcome: str | None = None


class Event(NamedTuple):
    event: str | None
    fingerprint: str | None = None
    output_hash: str | None = None
    found_hash: str | None = None
    message: str | None = None


def step(s: State, e: Event) -> State:
    """One event: where a record stands after it.

    start: reused (complete) where the output of the same fingerprint is there, refused where another
    one is, else translating.  stop: paused or failed, by its message.  built: publishing, with the
    output's hash.  published: complete.  What does not fit the state changes nothing.
    """
    if e.event == "start":
        if e.found_hash is None:
            return State("translating", e.fingerprint, None, None, None)
        same = s.status in ("complete", "publishing") and None not in (s.fingerprint, s.output_hash) and (s.fingerprint, s.output_hash) == (e.fingerprint, e.found_hash)
        return s._replace(status="complete", outcome="reused") if same else s._replace(outcome="refused")
    if e.event == "stop" and s.status == "translating":
        why = (e.message or "").lower()
        return s._replace(status="paused" if PAUSES.search(why) else "failed", last_error=why)
    if e.event == "built" and s.status == "translating":
        return s._replace(status="publishing", output_hash=e.output_hash)
    if e.event == "published" and s.status == "publishing":
        return s._replace(status="complete")
    return s


def histories(records: DataFrame, events: DataFrame, key: tuple[str, ...] = ("cik", "accn")) -> DataFrame:
    """records with their state after events(*key, event_no, event, fingerprint, output_hash, found_hash, message).

    records(*key, status, fingerprint, output_hash, last_error, and event_no where some were applied
    before) are unique by key and keep their other columns.  A record has one row whatever its events;
    n_held says how many of them wait for one before them.  Events of no record are left out, as are
    those without a number.

    Rows of a record are sorted and folded as they come: a task holds one state, however many events
    one record has.
    """
    keys = list(key)
    before = F.coalesce("event_no", F.lit(0)) if "event_no" in records.columns else F.lit(0)
    state = [x.split(" ")[0] for x in STATE.split(", ")]
    fields = [x.split(" ")[0] for x in EVENT.split(", ")]
    rest = [c for c in records.columns if c not in {*keys, *state}]
    empty = lambda names: [F.lit(None).cast("string").alias(n) for n in names]
    old = records.select(*keys, F.lit(-1).cast("long").alias("_no"), *(F.col(c).alias(f"_{c}") for c in ("status", "fingerprint", "output_hash", "last_error")), before.cast("long").alias("_before"), F.struct(F.lit(1).alias("_"), *rest).alias("_rest"), *empty(fields))
    row = old.schema["_rest"].dataType
    new = events.where("event_no >= 1").select(*keys, F.col("event_no").cast("long").alias("_no"), *empty(("_status", "_fingerprint", "_output_hash", "_last_error")), F.lit(None).cast("long").alias("_before"), F.lit(None).cast(row).alias("_rest"), *fields)
    rows = old.unionByName(new).repartition(*keys).sortWithinPartitions(*keys, "_no", *fields)
    at, n = rows.columns.index("_rest"), len(keys)
    names = [*keys, "_rest", *state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        open_: list | None = None  # key, the record's other columns as they came, state, last number applied, last one held, how many
        out: list[tuple] = []

        def some() -> pa.RecordBatch:
            *own, others = zip(*((*k, *s, last, held, r) for k, r, s, last, _, held in out), strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(own[:n], kinds, strict=True)), pa.concat_arrays(others), *(pa.array(c, pa.string()) for c in own[n:-2]), *(pa.array(c, pa.int64()) for c in own[-2:])], names)

        for batch in batches:
            kinds = [f.type for f in list(batch.schema)[:n]]
            rest_ = batch.column(at)
            plain = [c.to_pylist() for k, c in enumerate(batch.columns) if k != at]
            for i, values in enumerate(zip(*plain, strict=True)):
                k, no = values[:n], values[n]
                if no == -1:
                    if open_:
                        out.append(tuple(open_))
                    open_ = [k, rest_.slice(i, 1), State(*values[n + 1 : n + 5]), values[n + 5], 0, 0]
                elif open_ and open_[0] == k:
                    if no == open_[3] + 1:
                        open_[2], open_[3] = step(open_[2], Event(*values[n + 6 :])), no
                    elif no > open_[3] and no != open_[4]:
                        open_[4], open_[5] = no, open_[5] + 1
                if len(out) >= OUT_ROWS:
                    yield some()
                    out = []
        if open_:
            out.append(tuple(open_))
        if out:
            yield some()

    shape = ", ".join([*(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys), f"_rest {row.simpleString()}", STATE])
    got = rows.mapInArrow(run, shape)
    return got.select(*keys, *state, *(F.col(f"_rest.`{c}`").alias(c) for c in rest))
