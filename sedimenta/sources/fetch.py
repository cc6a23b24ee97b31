"""Fetching with byte caps, kinds of errors and retries.  The transport is injected; the one given here reads files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedimenta.sources.scratch import put, system

#: Bytes of an answer, at most, by what it is; attempts; seconds between requests to one host.
CAPS = {"document": 12 << 20, "concept": 4 << 20, "listing": 32 << 20}
ATTEMPTS, PAUSE = 3, 0.15
#: Statuses that mean too many requests, kinds of errors that a further attempt cannot mend,
#: and seconds before the next attempt for each attempt made, with their most.
LIMITED, FINAL = (403, 429), ("config", "notfound", "oversize", "client", "exception")
WAIT, WAIT_LIMITED = (1.5, 6.0), (3.0, 10.0)


@dataclass
class Answer:
    """What a transport gives: a status and chunks of bytes, or an error of the network."""

    status: int = 200
    chunks: Iterator[bytes] = iter(())
    error: str | None = None


def error_kind(status: int) -> str | None:
    """ok (none), notfound, ratelimit, client (other 4xx) or http."""
    if 200 <= status < 300:
        return None
    if status == 404:
        return "notfound"
    return "ratelimit" if status in LIMITED else "client" if 400 <= status < 500 else "http"


def wait_before(attempt: int, kind: str) -> float:
    """Seconds before the attempt after this one."""
    step, most = WAIT_LIMITED if kind == "ratelimit" else WAIT
    return min(step * attempt, most)


def received(answer: Answer, most: int) -> tuple[bytes | None, str | None]:
    """The body, or oversize as soon as it is longer than most; exactly most is accepted."""
    parts, n = [], 0
    for chunk in answer.chunks:
        n += len(chunk)
        if n > most:
            return None, "oversize"
        parts.append(chunk)
    return b"".join(parts), None


def fetch(url: str, transport: Callable[[str], Answer], *, most: int = CAPS["document"], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes | None, str | None, str | None, int]:
    """(body, kind of error, message, attempts made).

    Kinds: config (no web or file URL), notfound, ratelimit, client, http, net, oversize, exception
    (the transport raised).  Those that another attempt may mend are tried again after a while.
    """
    if not re.match(r"(https?|file)://", url or ""):
        return None, "config", f"not a URL: {url}", 0
    kind = message = None
    for n in range(1, max(1, attempts) + 1):
        try:
            answer = transport(url)
            kind, message = ("net", answer.error) if answer.error else (error_kind(answer.status), f"status {answer.status}")
            if kind is None:
                body, kind = received(answer, most)
                if kind is None:
                    return body, None, None, n
                message = f"over {most} bytes"
        except Exception as e:  # noqa: BLE001  an injected transport may raise anything
            kind, message = "exception", f"{type(e).__name__}: {e}"
        if kind in FINAL or n == attempts:
            return None, kind, message, n
        sleep(wait_before(n, kind))
    return None, kind, message, attempts


def paced(transport: Callable[[str], Answer], pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Answer]:
    """A transport whose requests to one host begin at least pause seconds apart, further attempts included."""
    last: dict[str, float] = {}

    def get(url: str) -> Answer:
        host = urlsplit(url).netloc.lower()
        if host in last and (wait := last[host] + pause - clock()) > 0:
            sleep(wait)
        last[host] = clock()
        return transport(url)

    return get


def _stored(kept: str, url: str) -> tuple | None:
    files, top = system(kept)
    path = f"{top}/{hashlib.sha256(url.encode()).hexdigest()}"
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as f:
        head, _, body = f.read().partition(b"\n")
    kind, message, attempts, has = json.loads(head)
    return body if has else None, kind, message, attempts


def fetched(df: DataFrame, url: str, transport: Callable[[str], Answer], *, most: int = CAPS["document"], attempts: int = ATTEMPTS, pause: float = PAUSE, kept: str | None = None) -> DataFrame:
    """df with body, error_kind, message and attempts.

    Rows are dealt by host, and a host's rows are asked for by one task, one after the other: so its
    pause holds for the whole job, however many tasks there are.  With kept, a folder that all tasks
    share, each answer is stored as soon as it is there, and what is stored (or stands there twice) is
    not asked for again: a job that was lost midway goes on where it was.
    """
    at = df.columns.index(url)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = paced(transport, pause)
        for batch in batches:
            for k, address in enumerate(batch.column(at).to_pylist()):
                got = _stored(kept, address) if kept and address else None
                if got is None:
                    got = fetch(address, ask, most=most, attempts=attempts)
                    if kept and address:
                        put(kept, hashlib.sha256(address.encode()).hexdigest(), json.dumps([*got[1:], got[0] is not None]).encode() + b"\n" + (got[0] or b""))
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *(pa.array([x], t) for x, t in zip(got, (pa.binary(), pa.string(), pa.string(), pa.int32()), strict=True))], [*batch.schema.names, "body", "error_kind", "message", "attempts"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z]+://([^/?#]*)", 1))
    return df.repartition(host).mapInArrow(run, f"{kinds}, body binary, error_kind string, message string, attempts int")


def file_transport(root: str, chunk: int = 1 << 16) -> Callable[[str], Answer]:
    """A transport that answers from files: host and path of a URL below root, in a folder that all tasks see."""

    def get(url: str) -> Answer:
        parts = urlsplit(url)
        path = os.path.normpath(os.path.join(root, parts.netloc, parts.path.lstrip("/")))
        if not path.startswith(os.path.normpath(root) + os.sep) or not os.path.isfile(path):
            return Answer(404)

        def chunks() -> Iterator[bytes]:
            with open(path, "rb") as f:
                while part := f.read(chunk):
                    yield part

        return Answer(200, chunks())

    return get


class FilingSource(DataSource):
    """spark.read.format("filings") with options urls (one a line) and root: one partition for each URL.

    Rows: url, body, error_kind, message, attempts.
    """

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return "url string, body binary, error_kind string, message string, attempts int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.root, self.most = options.get("root", ""), int(options.get("most", CAPS["document"]))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.urls] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield (partition.value, *fetch(partition.value, file_transport(self.root), most=self.most))
