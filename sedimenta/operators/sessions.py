"""Translation sessions that can be killed at any time: what is sent is reserved first, and what was answered is never asked again.

A session lives in a folder that driver and executors share.  Its tables only grow:

ledger: an attempt of each request, with its items and bytes, written before anything is sent.  What
is in the ledger counts against the budget of its run, whether an answer came or not.
claims: a file for each attempt, created by the task just before it calls the model.  An attempt that
has one is not sent again, also where Spark repeats the task; one without is sent by the next session
under its old reservation.  (Speculative copies of a task need a file system whose creation is exclusive.)
replies: a file for each answer or failure, written by the task as soon as it has it.
outcomes and cache: what the replies came to, and the good answers by key.  They are made from the
replies, so a session that is killed before loses nothing.

A run (a document) sends its requests in order, in one task, until one fails; its budget is its own.
Runs do not wait for each other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import fragments
from sedimenta.sources import scratch
from sedimenta.sources.scratch import Log

ITEM = "struct<id: int, k: string, leading: string, trailing: string, protected: string, tokens: array<string>, requires_language: boolean, literal_words: array<string>>"
#: Bytes of a request's body around its items.
FRAME = 200


@dataclass(frozen=True)
class Budget:
    """What a run may send in all sessions together."""

    requests: int = fragments.LIMITS["max_requests"][1]
    input_bytes: int = fragments.LIMITS["max_input_bytes"][1]
    wire_bytes: int = fragments.LIMITS["max_wire_bytes"][1]


class Session:
    """A session over pages(key, html); make_key turns a text into its key in the cache."""

    def __init__(self, spark: SparkSession, folder: str, key: str, make_key: Callable[[Column], Column], budget: Budget = Budget(), frame: int = FRAME):
        self.spark, self.folder, self.key, self.make_key, self.budget, self.frame = spark, folder.rstrip("/"), key, make_key, budget, frame
        self.ledger = Log(spark, f"{self.folder}/ledger", f"attempt string, run string, pos long, items array<{ITEM}>, input_bytes long, wire_bytes long")
        self.outcomes = Log(spark, f"{self.folder}/outcomes", "attempt string, outcome string")
        self.cache = Log(spark, f"{self.folder}/cache", "key string, value string")

    def plan(self, pages: DataFrame, html: str = "html") -> DataFrame:
        """The pages' nodes against the cache as it is (fragments.planned)."""
        return fragments.planned(pages, self.key, html, [self.cache.load()], self.make_key)

    def requests(self, plan: DataFrame) -> DataFrame:
        """run, pos, items, input_bytes and wire_bytes of what a plan lacks: each text once in its run, in order, in batches."""
        lacks = plan.where("needs and done is null").groupBy(F.col(self.key).cast("string").alias("run"), "k").agg(F.min(F.struct("pos", "text")).alias("f"))
        frag = fragments.fragments(lacks.select("run", "f.pos", "k", "f.text"), ["run", "pos", "k"])
        frag = scratch.written(frag.withColumn("n_bytes", F.octet_length("protected").cast("long")), "fragments")
        dealt = fragments.batches(frag, "run", "pos", "n_bytes")
        rows = frag.join(dealt.select("run", "pos", "batch_id"), ["run", "pos"])
        fields = ["k", "leading", "trailing", "protected", "tokens", "requires_language", "literal_words"]
        per = rows.groupBy("run", "batch_id").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("x"), F.sum("n_bytes").alias("input_bytes"))
        items = F.transform("x", lambda r, i: F.struct((i + 1).cast("int").alias("id"), *(r[f].alias(f) for f in fields)))
        body = F.to_json(F.transform("x", lambda r, i: F.struct((i + 1).alias("id"), r["protected"].alias("text"))))
        return per.select("run", "pos", items.alias("items"), "input_bytes", (F.octet_length(body) + self.frame).cast("long").alias("wire_bytes"))

    def reserve(self, requests: DataFrame) -> DataFrame:
        """Writes attempts of the requests that the budgets allow to the ledger, and returns them.

        In each run those before the first that would break a limit, what the run has reserved in all
        sessions counted.
        """
        used = self.ledger.load().groupBy("run").agg(F.count("*").alias("_n"), F.sum("input_bytes").alias("_i"), F.sum("wire_bytes").alias("_w"))
        by = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        zero = lambda c: F.coalesce(c, F.lit(0))
        rows = requests.join(used, "run", "left").withColumns({"n": zero("_n") + F.count("*").over(by), "i": zero("_i") + F.sum("input_bytes").over(by), "w": zero("_w") + F.sum("wire_bytes").over(by)})
        bad = (F.col("n") > self.budget.requests) | (F.col("i") > self.budget.input_bytes) | (F.col("w") > self.budget.wire_bytes) | (F.col("wire_bytes") > fragments.BODY)
        good = rows.withColumn("_bad", F.max(bad).over(by)).where("not _bad")
        return self.ledger.append(good.withColumn("attempt", F.concat(F.lit(uuid.uuid4().hex[:12] + "-"), F.sha2(F.concat_ws("|", "run", F.col("pos").cast("string")), 256).substr(1, 40))))

    def send(self, call: Callable[[list[dict]], str]) -> None:
        """Sends what is reserved and not claimed: each run in order, until one of its requests fails.

        call gets items {id, text} and returns the reply, or raises.
        """
        folder = self.folder
        settled = self.outcomes.load().select("attempt")
        rows = self.ledger.load().join(settled, "attempt", "left_anti").select("run", "pos", "attempt", F.to_json(F.transform("items", lambda r: F.struct(r["id"].alias("id"), r["protected"].alias("text")))).alias("items"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            failed = None
            for b in batches:
                for run_, _, attempt, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if run_ == failed or not scratch.created(f"{folder}/claims", attempt):
                        continue
                    try:
                        reply = {"reply": call(json.loads(items))}
                    except Exception as e:  # noqa: BLE001  an injected function may raise anything; the run ends
                        failed, reply = run_, {"error": str(e) or type(e).__name__}
                    scratch.put(f"{folder}/replies", f"{attempt}.json", json.dumps({"attempt": attempt} | reply).encode())
            yield from ()

        rows.repartition("run").sortWithinPartitions("run", "pos").mapInArrow(run, "x int").write.format("noop").mode("overwrite").save()

    def settle(self) -> None:
        """Checks the replies that are there, adds good answers to the cache, and notes what each attempt came to.

        Of several good answers to one key the least is kept; a reply with any fault gives none.
        """
        if not scratch.names(f"{self.folder}/replies"):
            return
        came = self.spark.read.schema("attempt string, reply string, error string").json(f"{self.folder}/replies").join(self.outcomes.load(), "attempt", "left_anti")
        came = scratch.written(came, "replies")
        asked = self.ledger.load().join(came.select("attempt"), "attempt", "left_semi").select(F.col("attempt").alias("batch"), F.explode("items").alias("i")).select("batch", "i.*")
        got = scratch.written(fragments.answers(came.where("error is null").select(F.col("attempt").alias("batch"), "reply"), asked.join(came.where("error is null").select(F.col("attempt").alias("batch")), "batch", "left_semi")), "answers")
        good = got.where("error is null").groupBy(F.col("k").alias("key")).agg(F.min(F.trim("answer")).alias("value"))
        self.cache.append(good.join(self.cache.load(), "key", "left_anti"))
        why = got.groupBy(F.col("batch").alias("attempt")).agg(F.min(F.when(F.col("error") != "batch", F.col("error"))).alias("why"))
        self.outcomes.append(came.join(why, "attempt", "left").select("attempt", F.coalesce("error", "why", F.lit("ok")).alias("outcome")))

    def run(self, pages: DataFrame, call: Callable[[list[dict]], str], html: str = "html") -> DataFrame:
        """Settles what a session before left, sends what the budgets allow, and returns report().

        What was reserved and not sent goes first, under its old reservation; the budget is asked for
        what is still missing then.
        """
        self.settle()
        self.send(call)
        self.settle()
        self.reserve(self.requests(self.plan(pages, html)))
        self.send(call)
        self.settle()
        return self.report(pages, html)

    def report(self, pages: DataFrame, html: str = "html") -> DataFrame:
        """key, html (null where an answer is missing), n_texts, n_missing, and what its run has reserved: requests, input_bytes, wire_bytes, failed."""
        plan = scratch.written(self.plan(pages, html), "plan")
        counts = plan.groupBy(self.key).agg(F.count_if("needs").alias("n_texts"), F.count_if(F.col("needs") & F.col("done").isNull()).alias("n_missing"))
        used = self.ledger.load().join(self.outcomes.load(), "attempt", "left").groupBy("run").agg(F.count("*").alias("requests"), F.sum("input_bytes").alias("input_bytes"), F.sum("wire_bytes").alias("wire_bytes"), F.count_if(F.col("outcome") != "ok").alias("failed"))
        rows = fragments.translated(plan, self.key).join(counts, self.key).withColumn("run", F.col(self.key).cast("string")).join(used, "run", "left").drop("run")
        return rows.select(self.key, "html", "n_texts", "n_missing", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("requests", "input_bytes", "wire_bytes", "failed")))
