"""URL filters: suffix rules first, a logistic regression for the rest.

Host and path are cut from the URL by Spark expressions.  A rule names a host (which also covers
its subdomains) and a path prefix; the longest fitting rule decides.  Where none fits, a logistic
regression on hashed character n-grams of host and path decides; it is trained on the driver from
a small labelled table of URLs.

A null URL, or one without "://", has an empty host and path; no rule fits it and the model judges
the empty strings.  Repeated URLs are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.blocks import Block, blocks, powers

#: Weights of the model (hash buckets).
BUCKETS = 1 << 18
#: Lengths of the character n-grams, in bytes.
SIZES = (3, 4, 5, 6)
#: (rule, verdict)
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: Words from which labelled() makes its table: topics that block lists usually hold, and everyday ones.  Fixed values.
UNWANTED = """spam adult casino poker betting slots jackpot roulette lottery gamble porn xxx sex nude escort camgirls hookup viagra pills
pharma steroids weightloss payday loans quickcash freemoney bitcoindoubler forex scam phishing malware virus trojan warez
crack keygen torrent piracy clickbait popup tracker banner ads advert affiliate redirect giveaway prize winner coupon
cheap replica fakeid essaywriter hacked exploit botnet""".split()
ORDINARY = """news blog docs wiki shop library museum school garden weather recipes travel forum science history music sport city
theatre archive university hospital church kitchen painting poetry football cycling hiking river mountain village
railway airport market bakery carpenter physics chemistry biology geology astronomy language grammar dictionary
software database compiler research journal college student teacher family children parents health nutrition yoga
novel cinema orchestra gallery festival harbour forest farming weather climate energy economy parliament council""".split()
#: Made-up names among the ordinary ones.
MADE_UP = 200
PREFIXES = ["", "www.", "m.", "blog."]
ENDINGS = [".com", ".org", ".net", ".info", ".example.com", ".example.org", ".example.net"]
PATHS = ["/", "/en/12", "/de/345.html", "/fr/678?page=2", "/es/90/", "/a/b#top", ""]


def labelled() -> list[tuple[str, int]]:
    """A small labelled table: 1 marks URLs to block.

    Hosts are single words, and pairs of words of one kind with and without a hyphen.  An unwanted
    word beside an ordinary one is unwanted, too.  Ordinary hosts are also made-up names of
    syllables, as a name that says nothing is no ground to block.
    Prefixes, endings and paths occur with both labels alike, so that only the words tell them apart.
    """
    out = []
    syllables = [c + v + e for c in "bdfghklmnprstvw" for v in "aeiou" for e in ("", "n", "r", "s", "th")]
    made_up = ["".join(syllables[(k * 7919 + j * 104_729 + j * j * k) % len(syllables)] for j in range(1, 3 + k % 3)) for k in range(MADE_UP)]
    mixed = [name for k, a in enumerate(UNWANTED) for j in range(3) for b in [ORDINARY[(k * 13 + j * 29) % len(ORDINARY)]] for name in (f"{a}-{b}" if j % 2 else f"{a}{b}", f"{b}{a}" if j % 2 else f"{b}-{a}")]
    for words, label in ((UNWANTED, 1), (ORDINARY, 0)):
        names = [*words, *(mixed if label else made_up), *(f"{a}{'-' if k % 2 else ''}{b}" for k, a in enumerate(words) for b in (words[(k + 7) % len(words)], words[(k * 5 + 3) % len(words)]) if a != b)]
        for k, name in enumerate(names):
            for j in range(4):
                out.append((f"https://{PREFIXES[(j + k) % len(PREFIXES)]}{name}{ENDINGS[(3 * j + k) % len(ENDINGS)]}{PATHS[(2 * j + k) % len(PATHS)]}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of each text, and the text of each."""
    cells, docs = [], []
    ends = np.repeat(b.offs[1:], np.diff(b.offs))
    at = np.arange(len(b.data))
    for n in SIZES:
        s = at[at + n <= ends]
        cells.append(b.hashes(s, s + n) & np.uint64(BUCKETS - 1))
        docs.append(b.doc_of(s))
    return np.concatenate(cells).astype(np.int64), np.concatenate(docs)


def _joined(host: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([f"^{h}${p}" for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)], pa.string())


def logits(b: Block, w: np.ndarray, bias: float) -> np.ndarray:
    cell, doc = features(b)
    return bias + np.bincount(doc, w[cell], b.n) / np.sqrt(np.maximum(np.bincount(doc, minlength=b.n), 1))


def train(hosts: list[str], paths: list[str], y: np.ndarray, *, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch adaptive gradient descent; n-gram vectors have unit length."""
    powers(1)
    w, bias, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6)
    column = _joined(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    (b,) = blocks(column, 1 << 30)
    cell, doc = features(b)
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=b.n), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + np.bincount(doc, w[cell], b.n) * scale)))
        g = (p - y) / len(y)
        gw = np.bincount(cell, (g * scale)[doc], BUCKETS) + ridge * w / len(y)
        seen += gw * gw
        w -= rate * gw / np.sqrt(seen) * (gw != 0)
        bias -= rate * g.sum()
    return w, bias


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, table: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each row."""
    spark = pages.sparkSession
    table = labelled() if table is None else table
    parts = spark.createDataFrame(table, "url string, label int").select(*(c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)), "label").toPandas()
    w, bias = train(list(parts["host"]), list(parts["path"]), parts["label"].to_numpy(float))
    w = w.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _joined(batch.column(1), batch.column(2))
            for b in blocks(text):
                part = batch.slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-logits(b, w, bias))), pa.float64())], ["page_id", "host", "path", "score"])

    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    scored = cut.mapInArrow(score, f"page_id {cut.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = rule_of(rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
