"""Digests of inventories, and cleaning that executes: refusals, crashes at any file, order of ranks, each file once."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import library as lib
from sedimenta.operators.lifecycle import Cleaning, changed, digest, folders, numbered

FILES = "path string, mode string, size long, sha256 string"


def test_digests(spark):
    rows = [(f"/w/{k % 3}/{k}/f{j}", "file", k, f"h{k}{j}") for k in range(20) for j in range(3)]
    df = spark.createDataFrame(rows, FILES)
    one = lambda x: x.agg(digest("path", "mode", "size", "sha256").alias("d")).first()["d"]
    assert one(df) == one(df.orderBy(F.rand(1)).repartition(7)) != one(df.union(df.limit(1))) and one(df.where("false")) != one(df)
    assert one(spark.createDataFrame([("a", "b", 1, None)], FILES)) != one(spark.createDataFrame([("a", "b", 1, "")], FILES)) != one(spark.createDataFrame([("ab", "", 1, "")], FILES))
    tree = folders(df)
    assert {r["folder"]: r["n"] for r in tree.collect()}["/w"] == 60 and tree.where("folder = ''").first()["n"] == 60
    after = df.withColumn("sha256", F.when(F.col("path") == "/w/1/4/f2", "x").otherwise(F.col("sha256"))).where("path not like '/w/2/%'")
    assert sorted(r["folder"] for r in changed(tree, folders(after)).collect()) == ["/w/1/4", *sorted(f"/w/2/{k}" for k in range(20) if k % 3 == 2)]


def test_global_places(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(5)
    got = [(r["g"], r["v"]) for r in numbered(df, [F.col("g"), F.col("v")], "place").orderBy("place").collect()]
    assert got == sorted(got) and [r["place"] for r in numbered(df, [F.col("v")], "place").orderBy("v").collect()] == list(range(1, 1001))
    assert numbered(df.where("false"), [F.col("v")], "place").count() == 0


def _library(spark, root, n=4):
    dirs = [f"{root}/work/{k:010d}/{k:010d}-26-000001" for k in range(n)]
    for d in dirs:
        os.makedirs(d)
        for f in ("page.htm", "image.png", "translation.json", "cleanup.json", "source.json"):
            with open(f"{d}/{f}", "w") as x:
                x.write(f"{d}{f}")
    records = spark.createDataFrame([(f"{k:010d}", f"{k:010d}-26-000001", "missing", None, d, f"{root}/en{k}", f"{root}/zh{k}") for k, d in enumerate(dirs)], "cik string, accn string, presence string, blocked string, dir string, original_path string, output_path string")

    def replan():
        found = [(os.path.join(d, f), "file", os.path.getsize(os.path.join(d, f)), open(os.path.join(d, f)).read()) for d, _, fs in os.walk(f"{root}/work") for f in fs]
        return lib.cleaning_plan(records, spark.createDataFrame(found, FILES), records.select("cik", "accn"))

    return replan


def _delete(note, fails=None):
    def delete(path):
        if fails and path.endswith(fails[0]) and not os.path.exists(fails[1]):
            open(fails[1], "w").close()
            os._exit(1)
        os.remove(path)
        with open(f"{note}/{time.time_ns()}-{os.urandom(4).hex()}", "w") as f:
            f.write(path)

    return delete


def _noted(note):
    return [open(f"{note}/{n}").read() for n in sorted(os.listdir(note))]


def test_a_plan_that_changed_is_refused_and_a_token_works_once(spark, tmp_path):
    root, note = str(tmp_path / "r"), str(tmp_path / "n")
    os.makedirs(note)
    replan = _library(spark, root)
    token = replan()[1].first()["signature"]
    with open(f"{root}/work/0000000001/0000000001-26-000001/page.htm", "a") as f:
        f.write("changed")
    job = Cleaning(spark, str(tmp_path / "c"))
    assert job.execute(token, replan, lib.deletion_rank, _delete(note)) == "changed" and not _noted(note)
    token = replan()[1].first()["signature"]
    assert job.execute(token, replan, lib.deletion_rank, _delete(note)) is None
    gone = _noted(note)
    assert len(gone) == len(set(gone)) == 20 and not [f for _, _, fs in os.walk(f"{root}/work") for f in fs]
    ranks = [3 if p.endswith("source.json") else 2 if p.endswith("cleanup.json") else 1 if p.endswith("translation.json") else 0 for p in gone]
    assert ranks == sorted(ranks)
    assert job.execute(token, replan, lib.deletion_rank, _delete(note)) == "used"


@pytest.mark.parametrize("at", ["image.png", "cleanup.json", "source.json"])
def test_a_crash_is_resumed_and_each_file_goes_once(spark, tmp_path, at):
    root, note = str(tmp_path / "r"), str(tmp_path / "n")
    os.makedirs(note)
    replan = _library(spark, root)
    job = Cleaning(spark, str(tmp_path / "c"))
    job.resume(_delete(note))
    assert not _noted(note)
    with pytest.raises(Exception, match="."):
        job.execute(replan()[1].first()["signature"], replan, lib.deletion_rank, _delete(note, (at, str(tmp_path / "dead"))))
    assert len(_noted(note)) < 20
    again = Cleaning(spark, str(tmp_path / "c"))
    again.resume(_delete(note))
    again.resume(_delete(note))
    assert len(_noted(note)) == len(set(_noted(note))) == 20 == again.gone().count()
