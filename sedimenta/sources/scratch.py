"""Folders that driver and executors share, for tables and files between steps."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, a path or a URI, and its path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def created(folder: str, name: str) -> bool:
    """Whether this call is the one that creates an empty file; in a local file system, of calls at once only one is."""
    files, top = system(folder)
    files.create_dir(top)
    path = f"{top}/{name}"
    if isinstance(files, fs.LocalFileSystem):
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    if files.get_file_info(path).type != fs.FileType.NotFound:
        return False
    files.open_output_stream(path).close()
    return True


def put(folder: str, name: str, content: bytes) -> None:
    """A file that is there whole or not at all."""
    files, top = system(folder)
    files.create_dir(top)
    new = f"{top}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(new) as f:
        f.write(content)
    files.move(new, f"{top}/{name}")


def names(folder: str) -> list[str]:
    """The files of a folder; none if it is not there."""
    files, top = system(folder)
    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if not x.base_name.startswith("."))


class Log:
    """A table that only grows: each append is a folder of Parquet files, which counts once a file below _commits names it."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def append(self, df: DataFrame) -> DataFrame:
        """The rows as they are read back; a failure before the commit leaves the table as it was."""
        name = f"data-{uuid.uuid4().hex}"
        df.select(*(x.strip().split(" ")[0] for x in self.columns())).write.parquet(f"{self.folder}/{name}")
        put(f"{self.folder}/_commits", f"{time.time_ns()}.json", json.dumps({"data": name}).encode())
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")

    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def load(self) -> DataFrame:
        files, top = system(self.folder)
        parts = []
        for n in names(f"{self.folder}/_commits"):
            with files.open_input_stream(f"{top}/_commits/{n}") as f:
                parts.append(f"{self.folder}/{json.loads(f.read())['data']}")
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where that is unset, a session whose executors are threads of the driver gets a local one; any
    other is refused, as its executors have other disks.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what several plans need is computed once, and lost executors don't lose it."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
