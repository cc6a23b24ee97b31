"""Files of a folder as tables: what is there, its content's digests, and finding lost files again by content.

Paths are relative to the folder, which may be a path or a URI that pyarrow knows.
Tasks list the folders; contents are read only where a digest is asked for, piece by piece in tasks, so
a file of any size takes the memory of one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.library import HITS, relink
from sedimenta.sources.scratch import put, system, written

#: Bytes of a piece, and levels of folders.
PIECE, LEVELS = 1 << 20, 16

_FILE = "path string, mode string, size long"
_DIGESTS = "path string, size long, sha256 string, n_read long, error string"


def listing(spark: SparkSession, folder: str, depth: int = LEVELS) -> DataFrame:
    """path, mode (file, directory or special) and size of all that is below a folder, empty files and folders included.

    Level by level: the folders of one are dealt to tasks, which list them; each level is a table.
    No content is read.  A missing folder is empty; one deeper than depth is refused.
    """
    modes = {fs.FileType.File: "file", fs.FileType.Directory: "directory"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got = store.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{path}", allow_not_found=True))
                lead = path + "/" if path else ""
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([lead + x.base_name for x in got], pa.string()), pa.array([modes.get(x.type, "special") for x in got], pa.string()), pa.array([x.size or 0 for x in got], pa.int64())], ["path", "mode", "size"])

    now, out = spark.createDataFrame([("",)], "path string"), spark.createDataFrame([], _FILE)
    for _ in range(depth + 1):
        level = written(now.repartition("path").mapInArrow(run, _FILE), "level")
        if level.isEmpty():
            return out
        out, now = out.union(level), level.where("mode = 'directory'").select("path")
    raise ValueError(f"the folder has more than {depth} levels")


def digests(files: DataFrame, folder: str, most: int | None = None, seen: Observation | None = None) -> DataFrame:
    """path, size (as read), sha256, n_read (bytes) and error of files(path, size): gone, changed (another size), too large, or unreadable.

    A file of over most bytes is not read.  Files are dealt anew by path, so that large ones of one
    folder don't meet in a task.  seen observes n_files and n_read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = system(folder)
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append({"path": path, **_digest(store, f"{top.rstrip('/')}/{path}", size, most)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("n_read", pa.int64()), ("error", pa.string())])
    out = files.select("path", "size").repartition("path").mapInArrow(run, _DIGESTS)
    return out if seen is None else out.observe(seen, F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_read"), F.lit(0)).alias("n_read"))


def _digest(store, path: str, size: int, most: int | None) -> dict:
    if most is not None and size > most:
        return {"size": size, "sha256": None, "n_read": 0, "error": "too large"}
    state, n = hashlib.sha256(), 0
    try:
        with store.open_input_stream(path) as f:
            # a file that grows meanwhile is read one piece beyond its size at most
            while n <= size and (piece := f.read(PIECE)):
                state.update(piece)
                n += len(piece)
    except FileNotFoundError:
        return {"size": None, "sha256": None, "n_read": n, "error": "gone"}
    except OSError as e:
        return {"size": None, "sha256": None, "n_read": n, "error": f"unreadable: {type(e).__name__}"}
    return {"size": n, "sha256": state.hexdigest() if n == size else None, "n_read": n, "error": None if n == size else "changed"}


def inventory(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """path, mode, size and sha256 of all files and folders below a folder; a file that cannot be read, or is over most bytes, has no sha256."""
    files = listing(spark, folder)
    return files.join(digests(files.where("mode = 'file'"), folder, most).select("path", "sha256"), "path", "left")


def of_sizes(files: DataFrame, lost: DataFrame) -> DataFrame:
    """The files whose size is that of a lost one; only these can be it."""
    return files.where("mode = 'file'").join(lost.select("size").distinct(), "size", "left_semi")


def found_again(spark: SparkSession, folder: str, lost: DataFrame, owned: DataFrame, *, hits: int = HITS, seen: Observation | None = None) -> DataFrame:
    """lost(cik, accn, sha256, size) with the paths below a folder of equal content that owned(path) lacks, as library.relink gives them.

    Files of other sizes, and owned ones, are not read.
    """
    free = of_sizes(listing(spark, folder), lost).withColumn("_low", F.lower("path")).join(owned.select(F.lower("path").alias("_low")), "_low", "left_anti")
    return relink(digests(free, folder, seen=seen).where("error is null"), lost, owned, hits)


def store(rows: DataFrame, folder: str) -> None:
    """Writes rows(path, content) as files; each is there whole or not at all, and a repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, _, name = path.rpartition("/")
                put(f"{folder.rstrip('/')}/{at}".rstrip("/"), name, content.as_buffer().to_pybytes())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number
