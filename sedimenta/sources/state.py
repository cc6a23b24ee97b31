"""State between runs: versions of a table, published by a pointer that is written last.

A version is a folder of Parquet files.  The pointer names the current one; a run that fails before
it writes the pointer leaves the state as it was.  Reading falls back to the version before if the
current one cannot be read.  One writer at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

#: Seconds for which a snapshot is fresh, and rows below which a new one is refused.
TTL, LEAST_ROWS = 7 * 86_400, 1000
#: Versions that are kept.
KEPT = 2


class Versions:
    """The versions of one table below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> list[dict]:
        """The published versions, newest first."""
        path = self._path(f"{self.folder}/current.json")
        if not self.fs.exists(path):
            return []
        lines = self.spark.read.text(f"{self.folder}/current.json").collect()
        return json.loads("".join(r["value"] for r in lines))

    def _point(self, versions: list[dict]) -> None:
        new, old = self._path(f"{self.folder}/current.new"), self._path(f"{self.folder}/current.json")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        # replaces the pointer in one step where the file system can
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(new, old, how)

    def load(self) -> DataFrame | None:
        """The current version, or the one before if it cannot be read; None before the first."""
        for v in self._pointer():
            df = self._read(v["name"])
            if df is not None:
                return df
        return None

    def _read(self, name: str) -> DataFrame | None:
        """A version; None if it cannot be read."""
        try:
            df = self.spark.read.parquet(f"{self.folder}/{name}")
            df.limit(1).collect()
            return df
        except (PySparkException, Py4JJavaError):
            return None

    def info(self, now: float | None = None) -> dict | None:
        """name, rows, written and age of the current version."""
        found = self._pointer()
        return found[0] | {"age": (time.time() if now is None else now) - found[0]["written"]} if found else None

    def publish(self, df: DataFrame, check: Callable[[DataFrame], str | None] | None = None, now: float | None = None) -> str | None:
        """Writes a version and, if check finds no fault in it, points to it; returns the fault."""
        name = f"v{int((time.time() if now is None else now) * 1000)}-{len(self._pointer())}"
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        written = self.spark.read.parquet(f"{self.folder}/{name}")
        fault = check(written) if check else None
        if fault:
            self.fs.delete(self._path(f"{self.folder}/{name}"), True)
            return fault
        known = self._pointer()
        self._point([{"name": name, "rows": written.count(), "written": time.time() if now is None else now}, *known][:KEPT])
        for v in known[KEPT - 1 :]:
            self.fs.delete(self._path(f"{self.folder}/{v['name']}"), True)
        return None

    def revise(self, change: Callable[[DataFrame | None], DataFrame], check: Callable[[DataFrame], str | None] | None = None, adopt: bool = False, now: float | None = None) -> str | None:
        """Publishes change(current version), None before the first; returns the fault.

        Where the pointer or the newest version cannot be read nothing is written, as a state that
        was not seen would be lost; adopt goes on from the version before, if that can be read.
        """
        try:
            known = self._pointer()
        except (ValueError, PySparkException, Py4JJavaError):
            return "the pointer cannot be read"
        df = self._read(known[0]["name"]) if known else None
        if known and df is None:
            df = self.load() if adopt else None
            if df is None:
                return "the newest version cannot be read"
        return self.publish(change(df), check, now)

    def restore(self) -> bool:
        """Points to the version before, if there is one."""
        known = self._pointer()
        if len(known) < 2:
            return False
        self._point(known[1:])
        return True

    def clear(self) -> None:
        self.fs.delete(self._path(self.folder), True)


def cached(versions: Versions, fetch: Callable[[], tuple[DataFrame | None, str | None]], *, ttl: float = TTL, least: int = LEAST_ROWS, now: float | None = None) -> tuple[DataFrame | None, dict]:
    """(the snapshot, how it was got: source fresh, fetched or stale, degraded, error).

    A fresh snapshot is read; a stale one is fetched anew.  If that fails, or gives too few rows, the
    stale one serves, degraded; but for a fault of the configuration, which is returned.
    """
    info = versions.info(now)
    if info and info["age"] < ttl:
        return versions.load(), {"source": "fresh", "degraded": False, "error": None}
    df, error = fetch()
    if df is not None:
        error = versions.publish(df, lambda x: "too few rows" if x.count() < least else None, now)
        if error is None:
            return versions.load(), {"source": "fetched", "degraded": False, "error": None}
    old = versions.load() if error != "config" else None
    return old, {"source": "stale" if old is not None else None, "degraded": old is not None, "error": error}
