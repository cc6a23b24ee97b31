"""Inventories of stored files: digests in pieces, candidates by size first, and bytes that were read."""

import hashlib
import os

import pytest
from pyspark.sql import Observation

from sedimenta.sources import files


def _folder(tmp_path):
    top = tmp_path / "a lib+%20é"
    made = {"x/1.bin": b"a" * 10, "x/2.bin": b"b" * 10, "x/y/3 4.bin": b"a" * 10, "big.bin": bytes(range(256)) * 9000, "empty": b"", "z/5.bin": b"c" * 11}
    for p, b in made.items():
        os.makedirs((top / p).parent, exist_ok=True)
        (top / p).write_bytes(b)
    (top / "none").mkdir()
    return str(top), made


def test_inventory(spark, tmp_path):
    top, made = _folder(tmp_path)
    got = {r["path"]: r for r in files.inventory(spark, top).collect()}
    assert {p: r["sha256"] for p, r in got.items() if r["mode"] == "file"} == {p: hashlib.sha256(b).hexdigest() for p, b in made.items()}
    assert {p for p, r in got.items() if r["mode"] == "directory"} == {"x", "x/y", "z", "none"} and got["big.bin"]["size"] == len(made["big.bin"]) > files.PIECE
    small = {r["path"]: r["sha256"] for r in files.inventory(spark, top, most=100).collect()}
    assert small["big.bin"] is None and small["x/1.bin"] is not None


def test_found_again_reads_only_equal_sizes(spark, tmp_path):
    top, made = _folder(tmp_path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lost = spark.createDataFrame([("1", "a", sha(b"a" * 10), 10), ("2", "b", sha(b"q" * 10), 10), ("3", "c", sha(b"w" * 99), 99)], "cik string, accn string, sha256 string, size long")
    owned = spark.createDataFrame([("X/1.BIN",)], "path string")
    seen = Observation("read")
    got = {r["cik"]: (r["paths"], r["error"]) for r in files.found_again(spark, top, lost, owned, seen=seen).collect()}
    assert got == {"1": (["x/y/3 4.bin"], None), "2": ([], "not found"), "3": ([], "not found")}
    assert seen.get == {"n_files": 2, "n_read": 20}


def test_files_that_change(spark, tmp_path):
    top, _ = _folder(tmp_path)
    rows = spark.createDataFrame([("x/1.bin", 9), ("x/2.bin", 10), ("no file", 3)], "path string, size long")
    got = {r["path"]: r["error"] for r in files.digests(rows, top).collect()}
    assert got == {"x/1.bin": "changed", "x/2.bin": None, "no file": "gone"}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a/1", bytearray(b"x")), ("2", bytearray(b"yy"))], "path string, content binary")
    for _ in range(2):
        files.store(rows, str(tmp_path / "s"))
    assert sorted((r["path"], r["size"]) for r in files.listing(spark, str(tmp_path / "s")).where("mode = 'file'").collect()) == [("2", 2), ("a/1", 1)]
    assert files.listing(spark, str(tmp_path / "not there")).count() == 0
    with pytest.raises(ValueError):
        files.listing(spark, str(tmp_path), depth=1)
