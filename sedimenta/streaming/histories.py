"""Translation events as a stream: the state of each record is kept by key, and changed by the same steps as in tables.

State: where the record stands, the last number applied, and the events that wait for one before
them.  Numbers that were applied are ignored when they come again, so a source that repeats itself
after a failure, and any split into micro-batches, lead to the same rows.  The state store must be
one that holds maps (RocksDB); `prepared` sets it for queries that a session starts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sedimenta.operators.histories import EVENT, STATE, Event, State, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Histories(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, fingerprint string, output_hash string, last_error string, outcome string, event_no long")
        self.held = handle.getMapState("held", "event_no long", EVENT)

    def handleInitialState(self, key, row: Row, timerValues) -> None:
        self.state.update((row["status"], row["fingerprint"], row["output_hash"], row["last_error"], None, row["event_no"] or 0))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = tuple(self.state.get()) if self.state.exists() else (*State(), 0)
        s, last = State(*known[:5]), known[5]
        come: dict[int, Event] = {}
        for r in rows:
            no = r["event_no"]
            if no is not None and no > last:
                e = Event(*(r[f] for f in Event._fields))
                come[no] = min(come.get(no, e), e, key=lambda x: tuple((v is not None, v or "") for v in x))
        for no, e in come.items():
            if not self.held.containsKey((no,)):
                self.held.updateValue((no,), tuple(e))
        while self.held.containsKey((last + 1,)):
            last += 1
            s = step(s, Event(*self.held.getValue((last,))))
            self.held.removeKey((last,))
        self.state.update((*s, last))
        yield Row(**{f"k{i}": k for i, k in enumerate(key)}, **s._asdict(), event_no=last, n_held=sum(1 for _ in self.held.keys()))

    def close(self) -> None:
        pass


def histories(events: DataFrame, records: DataFrame | None = None, key: tuple[str, ...] = ("cik", "accn")) -> DataFrame:
    """The rows of records that a stream of events(*key, event_no, event, ...) changes, in update mode.

    records(*key, status, fingerprint, output_hash, last_error, event_no): where records stand before
    the stream begins; others begin as pending.
    """
    shape = ", ".join([*(f"k{i} {events.schema[k].dataType.simpleString()}" for i, k in enumerate(key)), STATE])
    start = None if records is None else records.select(*key, "status", "fingerprint", "output_hash", "last_error", "event_no").groupBy(*key)
    got = events.groupBy(*key).transformWithState(Histories(), shape, "Update", "None", start)
    return got.withColumnsRenamed({f"k{i}": k for i, k in enumerate(key)})
