"""How far the words of a source stand from those of the other sources of its language.

Plain relational: terms are exploded from regular-expression matches and counted by group
(lang, source); a language keeps the terms that occur in some of its documents at least; every group
is crossed with the kept terms of its language, so that absent terms are zeros; groups meet in a
self-join on language and term, and their divergences are summed and ranked.  All on the JVM.

A group's share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)), N its count over kept
terms, V their number; the divergence of p from q is floor((p - q)^2 / q).  Shares are computed in
decimals, so counts may exceed 9e9; the sum of all shares of a group is below SCALE + 2 V, so sums of
squares stay within a long up to a hundred million kept terms.

Counts are folded in the tasks that read the documents, and so a hot word, source or language reaches
a reducer once a task.  Groups are crossed with the vocabulary in parts of PART terms, so neither a
language nor a source meets one task whole, and nothing is broadcast by hint.

Null text, lang and source count as ''.  Repeated rows count as often as they stand there.  A group
without terms still has a row for each other group of its language; with no kept term at all these
are 0.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.tables import Scratch

#: A term: letters A-Z and whatever is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that hold a kept term at least, what shares are counted in, and ranks of the term part.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Kept terms that meet the groups of their language at once.
PART = 4096


def grouped(docs: DataFrame) -> DataFrame:
    """lang, source and the terms of each document in an array."""
    empty = F.lit("")
    text = F.translate(F.coalesce("text", empty), ascii_uppercase, ascii_lowercase)
    return docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.regexp_extract_all(text, F.lit(TERM), 0).alias("terms"))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs (rows that hold it) and n (its occurrences)."""
    each = grouped(docs).select("lang", "source", F.posexplode(F.array(F.array_distinct("terms"), "terms")).alias("all", "terms"))
    each = each.select("lang", "source", "all", F.explode("terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("all") == 0).alias("docs"), F.count_if(F.col("all") == 1).alias("n"))


def share(n: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / (total + terms)), exactly: in longs where they hold it, else in decimals."""
    small = F.call_function("div", F.lit(scale).cast("long") * (n + 1), total + terms)
    wide = F.call_function("div", F.lit(scale).cast("decimal(38,0)") * (n + 1).cast("decimal(38,0)"), (total + terms).cast("decimal(38,0)"))
    return F.lit(1) + F.when(n < (2**63 - 1) // scale - 1, small).otherwise(wide)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def densified(docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCS, scale: int = SCALE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: lang, source and their number gid; kept: lang, term and their number tid; tid, gid, n, p and q of each group and each kept term of its language).

    p is the group's share, q the language's.  Terms and groups are numbered once, so that what is as
    large as groups times terms is joined by numbers.
    """
    counts = scratch.write(counted(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    kept = scratch.write(kept.select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "lang_n"), "kept")
    groups = scratch.write(grouped(docs).select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    known = scratch.write(counts.join(kept.select("tid", "lang", "term"), ["lang", "term"]).join(groups, ["lang", "source"]).select("tid", "gid", "n"), "known")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = known.groupBy("gid").agg(F.sum("n").alias("total"))
    parts = 1 + kept.count() // PART
    own = groups.join(langs, "lang").join(totals, "gid", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = own.join(kept.select("tid", "lang", "lang_n", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")), ["lang", "part"])
    every = every.join(known, ["tid", "gid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = share(F.col("n"), F.coalesce("total", F.lit(0)), F.col("terms"), scale)
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), scale)
    return groups, kept, scratch.write(every.select("tid", "gid", "n", p.alias("p"), q.alias("q")), "dense")


def audit(docs: DataFrame, *, least: int = LEAST_DOCS, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of docs(text, lang, source).

    Part pair: each other source of the language, by the divergence of the group from it over all kept
    terms.  Part term: the terms that the group has more of than its language, by their divergence
    from it, the first top of them.
    """
    scratch = Scratch(docs.sparkSession)
    groups, kept, dense = densified(docs, scratch, least, scale)
    one, two = dense.select("tid", "gid", "p"), dense.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"))
    sums = one.join(two, "tid").where("gid <> other").groupBy("gid", "other").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("other")), "lang").where("gid <> other")
    pairs = pairs.join(sums, ["gid", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    terms = dense.where("n > 0 and p > q").select("tid", "gid", divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.join(groups.select("gid", "source"), "gid").join(kept.select("tid", "lang", F.col("term").alias("item")), "tid")
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
