"""One run from subscriptions to books: plan, fetch, clean, record; and searches of a session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import html
from sedimenta.functions.dates import years_before
from sedimenta.functions.text import archive_url, concept_url, looks_like_json
from sedimenta.operators import companies, facts, filings, library, updates
from sedimenta.sources.fetch import CAPS, Answer, fetched
from sedimenta.sources.scratch import written
from sedimenta.sources.state import Versions

#: Years and rows that a search of filings covers.
YEARS, BUDGET = 3, 5000


def traced(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """df whose rows are counted as it is computed; the observation has stage and rows after an action."""
    seen = Observation(stage)
    return df.observe(seen, F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows")), seen


def made(new: DataFrame, transport: Callable[[str], Answer], have: DataFrame | None = None, pause: float = 0.0, kept: str | None = None) -> DataFrame:
    """new(cik, accn, form, date, primary) with outcome, html and bytes: fetched and cleaned in one pass, one request for each filing.

    have(cik, accn) are books that exist; they are reused.  A failure is an outcome of its row and
    ends nothing; a document that is too short is one, too.  kept: a folder for answers (see fetched).
    """
    old = have.select("cik", "accn", F.lit(True).alias("_old")) if have is not None else new.select("cik", "accn").limit(0).withColumn("_old", F.lit(True))
    rows = new.join(old, ["cik", "accn"], "left").withColumn("url", F.when(F.coalesce("primary", F.lit("")) != "", archive_url(F.col("cik"), F.col("accn"), F.col("primary"))))
    todo = rows.where("_old is null").drop("_old")
    got = fetched(todo, "url", transport, most=CAPS["document"], pause=pause, kept=kept).withColumn("raw", F.decode("body", "UTF-8")).withColumn("bytes", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")).drop("body")
    got = html.cleaned(got, "raw")
    enough = F.coalesce("long_enough", F.lit(False))
    outcome = F.when(F.col("error_kind").isNotNull() | ~enough, "failed").otherwise("made")
    why = F.coalesce("error_kind", F.when(~enough, "too short"))
    out = got.select("cik", "accn", "form", "date", outcome.alias("outcome"), why.alias("why"), F.when(outcome == "made", F.col("clean")).alias("html"), F.coalesce("n_images", F.lit(0).cast("long")).alias("images"), "bytes")
    reused = rows.where("_old").select("cik", "accn", "form", "date", F.lit("reused"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return out.union(reused)


def run(listing: DataFrame, subs: Versions, transport: Callable[[str], Answer], keep: Callable[[DataFrame], DataFrame], *, have: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(outcomes, one row of totals): plans the listing, makes what is new, lets keep(outcomes) write it, and records what it returns.

    keep writes the books to a table and returns the outcomes read from there, so that nothing is
    fetched twice.  What failed is new again in the next run, and the baseline stays; if the state
    cannot be published, nothing is recorded and the run fails.
    """
    now = subs.load()
    rows = updates.normalized(listing)
    new, ups = updates.plan(rows, now, **options)
    primary = rows.groupBy("cik", "accn").agg(F.min_by("primary", "pos").alias("primary"))
    outcomes = keep(made(new.join(primary, ["cik", "accn"], "left"), transport, have))
    done = outcomes.where(F.col("outcome").isin("made", "reused")).select("cik", "accn")
    fault = subs.publish(updates.record_seen(now, new, ups, done), lambda x: "rows were lost" if x.count() != now.count() else None)
    if fault:
        raise RuntimeError(fault)
    idle = ups.where("new_count = 0").select("cik", F.lit("no_new").alias("outcome"), F.lit(0).cast("long").alias("images"), F.lit(0).cast("long").alias("bytes"))
    return outcomes, library.run_info(outcomes.select("cik", "outcome", "images", "bytes").union(idle))


def metrics(companies_: DataFrame, transport: Callable[[str], Answer], *, definitions: DataFrame | None = None, pause: float = 0.0, kept: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that a chapter shows, one row for each company and metric) of companies(cik): each tag is asked for once, and all the way to the report.

    The answers are a table before anything is derived from them.  A tag that a company never
    reported (not found) and one that could not be got are told apart in the report.
    """
    spark = companies_.sparkSession
    defs = facts.definitions(spark) if definitions is None else definitions
    tags = [r["tag"] for r in facts.all_tags(defs).collect()]  # a few dozen
    asked = companies_.select("cik").distinct().select("cik", F.explode(F.array(*map(F.lit, tags))).alias("tag")).withColumn("url", concept_url(F.col("cik"), F.col("tag")))
    got = written(fetched(asked, "url", transport, most=CAPS["concept"], pause=pause, kept=kept).withColumn("body", F.decode("body", "UTF-8")), "concepts")
    rows = facts.facts(got.where("error_kind is null"), ["cik", "tag"]).join(defs, "tag")
    shape = got.where("error_kind is null").select("cik", "tag", looks_like_json(F.col("body")).alias("ok")).where("not coalesce(ok, false)")
    errors = got.where("error_kind is not null").select("cik", "tag", F.when(F.col("error_kind") == "notfound", 404).alias("code"), F.concat_ws(": ", "error_kind", "message").alias("message"))
    errors = errors.unionByName(shape.select("cik", "tag", F.lit(None).cast("int").alias("code"), F.lit("no JSON").alias("message")))
    found, info = facts.periods(rows, ["cik", "tag"])
    return facts.report(found, written(facts.candidates(defs, companies_.select("cik").distinct(), info, errors), "candidates"))


class Generations:
    """Jobs of a session by number: starting a new one cancels those before, and late results are known by their number."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.now, self.cancel = spark, name, 0, spark.interruptTag

    def start(self) -> int:
        if self.now:
            self.stop()
        else:
            self.now = 1
        self.spark.addTag(f"{self.name}-{self.now}")
        return self.now

    def current(self, number: int) -> bool:
        return number == self.now

    def stop(self) -> None:
        self.cancel(f"{self.name}-{self.now}")
        self.spark.removeTag(f"{self.name}-{self.now}")
        self.now += 1


@dataclass
class Search:
    """A search of a session: a company is picked, its filings are listed once, and filtered anew without a new listing."""

    directory: DataFrame
    sources: Callable[[int], DataFrame]
    today: date
    options: dict = field(default_factory=dict)
    answer: DataFrame | None = None
    entries: DataFrame | None = None
    envelope: DataFrame | None = None

    def start(self, query: str) -> DataFrame:
        """The candidates of a query; what was listed before is dropped."""
        self.entries = self.envelope = None
        top, self.answer = companies.resolve(self.directory, query)
        return top

    def load(self, cik: int, **options) -> DataFrame:
        """The filings of a company in the last years, newest first."""
        self.options = {"since": years_before(self.today, YEARS), "max_total": BUDGET} | options
        entries, self.envelope, _ = filings.list_filings(self.sources(cik), filings.Filter(**self.options))
        self.entries = entries.cache()
        return self.entries

    def refilter(self, cik: int, **options) -> DataFrame:
        """Filings under another filter: from the list at hand if it is whole and covers it, else listed anew."""
        whole = self.envelope is not None and self.envelope.where("not truncated and sources_failed = 0 and error is null").count() == 1
        wider = self.options.keys() - {"since", "max_total"} or options.get("since", self.options.get("since", "")) < self.options.get("since", "")
        if whole and not wider and not options.get("limit"):
            return filings.refiltered(self.entries, self.envelope, filings.Filter(**(self.options | options)))
        return self.load(cik, **options)

    def refresh(self, cik: int) -> DataFrame:
        """The list at hand is dropped and read anew with its options."""
        if self.entries is not None:
            self.entries.unpersist()
        options, self.entries, self.envelope = self.options, None, None
        return self.load(cik, **options)
