"""Text for translation: units, protected fragments, validation of answers, batches and ledgers.

A fragment is a piece of text with its units (numbers, links, identifiers) replaced by numbered
placeholders.  Answers must bring all of them back in order and add none.  Model calls are injected
functions of the driver; nothing here sends anything.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import prefixed_digest

#: What a text is cut into, tried in order (else one character), symbols that are kept, words that are names,
#: and whole texts that are names.
UNITS = [r"https?://[^\s<>]+", r"&[#A-Za-z0-9]+;", r"SECX[0-9]+X", r"[+\-$]?[0-9][0-9,.]*%?", r"[A-Za-z_][A-Za-z0-9_.:/\-]*"]
SYMBOLS = "$€£¥￥%+-−()"
NAMES = """SEC CIK GAAP IFRS FASB ASC IRS CEO CFO COO EPS EBIT EBITDA USD EUR GBP JPY CNY CAD AUD NYSE NASDAQ U.S. US
AAPL MSFT AMZN GOOG GOOGL META NVDA TSLA""".split()
LITERALS = {"iPhone", "Mac", "iPad", "Epic Games", "/s/ Kevan Parekh", "Kevan Parekh"}
#: Items and bytes of a batch, bytes of a request's body, of a piece of text and of an answer.
ITEMS, BYTES, BODY, PIECE, ANSWER = 8, 1200, 16_384, 2400, 262_044
#: Least, usual and most of a translator's limits.
LIMITS = {"max_chars": (8, 2400, 8000), "max_requests": (1, 20, 1000), "max_input_bytes": (1, 48_000, 2_000_000), "max_wire_bytes": (1, 16_384_000, 16_384_000), "max_output_tokens": (64, 16_384, 16_384)}
#: Rows that a fold gives back at once.
OUT_ROWS = 10_000

_UNIT = re.compile("|".join(UNITS) + "|.", re.DOTALL)
_MARK = re.compile("SECX([0-9]+)X")
_HYPHENED = re.compile(r"[A-Za-z_][A-Za-z_.\-]*[A-Za-z_]")
_CJK = re.compile("[㐀-鿿\U00020000-\U000323af]")
_TRADEMARK = [("&reg;", "®"), ("&#174;", "®"), ("&trade;", "™"), ("&#8482;", "™")]

FRAGMENT = "struct<protected: string, tokens: array<string>, requires_language: boolean, literal_words: array<string>>"


def limits(**given: int) -> dict[str, int]:
    """A translator's limits, those given drawn into their bounds."""
    return {k: min(max(given.get(k, usual), least), most) for k, (least, usual, most) in LIMITS.items()}


def units(text: str) -> list[str]:
    """The text cut into units that must not be split; joined, they are the text."""
    return _UNIT.findall(text)


@lru_cache(1 << 16)  # words come again and again
def _kept(u: str) -> bool:
    """Whether a unit must come back unchanged."""
    return u in SYMBOLS or any(c.isascii() and c.isdigit() for c in u) or unicodedata.category(u[0]) == "Nd" or u.startswith(("http://", "https://")) or re.fullmatch(r"&[#A-Za-z0-9]+;", u) is not None or u in NAMES or ":" in u


def protect(text: str) -> tuple[str, list[str], bool, list[str]]:
    """The text with placeholders, the units they stand for, whether it needs a translation, and its hyphenated words.

    Text that has no letter outside placeholders needs none, nor do names under a trademark and the
    literal names.  Placeholders that the text itself holds are units like others.
    """
    out, kept, words = [], [], []
    for u in units(text):
        if _kept(u):
            kept.append(u)
            out.append(f"SECX{len(kept)}X")
        else:
            out.append(u)
            if "-" in u:
                word = u.lower().rstrip(".")
                if _HYPHENED.fullmatch(word) and re.search("[a-z]-[a-z]", word):
                    words.append(word)
    protected = "".join(out)
    rest = re.sub(r"(?<![A-Za-z])us-gaap(?![A-Za-z])", "", _MARK.sub("", protected))
    mark = text
    for entity, sign in _TRADEMARK:
        mark = mark[: -len(entity)] + sign if mark.endswith(entity) else mark
    mark = re.sub("&#[xX][aA][eE];$", "®", re.sub("&#[xX]2122;$", "™", mark))
    needs = re.search("[A-Za-z]", rest) is not None and text not in LITERALS and not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.%\-]*[®™]", mark)
    return protected, kept, needs, list(dict.fromkeys(words))


def validate(answer: str | None, protected: str, kept: list[str], needs: bool = True, words: list[str] = ()) -> tuple[str | None, str | None]:
    """(the text with its units restored, None), or (None, why the answer is refused).

    empty; markup (tags, code fences, control bytes); marks (placeholders missing, out of order or
    new, digits, symbols but for hyphens of the text's own words); language (no character of the
    wanted language); echo (the text itself).
    """
    if answer is None or not answer.strip():
        return None, "empty"
    if re.search("[<>]|```|[\x00-\x08\x0b\x0c\x0e-\x1f]", answer):
        return None, "markup"
    rest = _MARK.sub("", answer)
    signs = re.sub(r"[A-Za-z_][A-Za-z_.\-]*", lambda m: "" if m[0].lower().rstrip(".") in words else m[0], rest)
    if [m for m in _MARK.findall(answer)] != [str(k + 1) for k in range(len(kept))] or "SECX" in rest or any(c in SYMBOLS for c in signs) or any(unicodedata.category(c) == "Nd" for c in rest):
        return None, "marks"
    if needs and not _CJK.search(rest):
        return None, "language"
    if needs and " ".join(answer.split()).lower() == " ".join(protected.split()).lower():
        return None, "echo"
    return _MARK.sub(lambda m: kept[int(m[1]) - 1], answer.replace("&", "&amp;")), None


def fragments(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, leading and trailing blanks, and the fields of the fragment between them; null text counts as empty."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [protect(t or "") for t in batch.column(len(keys)).to_pylist()]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *batch.columns[len(keys) + 1 :], *cols], [*keys, "leading", "trailing", "protected", "tokens", "requires_language", "literal_words"])

    body = F.coalesce(F.col(text), F.lit(""))
    core = F.regexp_replace(body, r"^\s+|\s+$", "")
    lead = F.regexp_extract(body, r"^(\s*)", 1)
    trail = F.when(core == "", "").otherwise(F.regexp_extract(body, r"(\s*)$", 1))
    rows = df.select(*keys, core.alias("_core"), lead.alias("_lead"), trail.alias("_trail"))
    return rows.mapInArrow(run, f"{kinds}, leading string, trailing string, protected string, tokens array<string>, requires_language boolean, literal_words array<string>")


def validated(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df (with a fragment's fields) with restored, the text with its blanks, and error, why the answer is refused."""
    names = [answer, "protected", "tokens", "requires_language", "literal_words", "leading", "trailing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            got = [(validate(a, p, t, q, w or []), lead, trail) for a, p, t, q, w, lead, trail in zip(*parts, strict=True)]
            text = pa.array([None if r is None else lead + r + trail for (r, _), lead, trail in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text, pa.array([e for (_, e), _, _ in got], pa.string())], [*batch.schema.names, "restored", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, restored string, error string")


def pieces(text: str, size: int = PIECE) -> list[str] | None:
    """The text in pieces of at most size bytes, cut between units; None if a unit is longer."""
    out, now, used = [], [], 0
    for u in units(text):
        n = len(u.encode())
        if n > size:
            return None
        if used + n > size:
            out.append("".join(now))
            now, used = [], 0
        now.append(u)
        used += n
    return [*out, "".join(now)]


_NODE = re.compile(r"<!--.*?-->|<[^>]*>|[^<]+", re.DOTALL)
_REFUSED = re.compile(r"<(script|style|!doctype)\b", re.IGNORECASE)


def nodes(html: str) -> list[tuple[str, str]] | None:
    """(tag or text, bytes) in order; joined, they are the html.  None for scripts, styles, doctypes and broken tags."""
    out = [("tag" if x[0] == "<" else "text", x) for x in _NODE.findall(html)]
    return None if _REFUSED.search(html) or "".join(x for _, x in out) != html else out


def html_pieces(df: DataFrame, key: str, html: str, size: int = PIECE) -> DataFrame:
    """key, pos, kind (tag, text or error) and text of every node, long texts in several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, pos = nodes(h or ""), 0
                for kind, x in [("error", "")] if found is None else found:
                    cut = pieces(x, size) if kind == "text" else [x]
                    for p in cut if cut is not None else [x]:
                        rows.append((k, pos, kind if cut is not None else "error", p))
                        pos += 1
            for s in range(0, len(rows), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + OUT_ROWS], strict=True), (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()), strict=True)], [key, "pos", "kind", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, pos long, kind string, text string")


def assembled(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows' texts of each key in order of pos, as one; null where a text is missing."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("t")))), lambda r: r["t"])
    return rows.groupBy(key).agg(F.when(F.count(F.col(text)) == F.count("*"), F.array_join(whole, "")).alias("html"))


def cache_key(text: Column, *, version: str, endpoint: str, model: str, thinking: str, language: str) -> Column:
    """The key of a text in the cache: a digest that changes with anything that changes the answer."""
    return prefixed_digest(*map(F.lit, (version, endpoint, model, thinking, language)), text)


def fingerprint(*, version: str, endpoint: str, model: str, thinking: str, max_chars: int, language: str) -> str:
    """A digest of a translator's settings."""
    import hashlib

    return hashlib.sha256("\n".join([version, endpoint, model, thinking, str(max_chars), language]).encode()).hexdigest()


def cached(df: DataFrame, caches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Fragments with restored and error from the first cache that has a good answer; caches: (key column, table key, value).

    The newest comes first, older ones follow; an answer that validation refuses counts as missing.
    """
    out = None
    left = df
    for column, cache in caches:
        hit = validated(left.join(cache.select(F.col("key").alias(column), F.col("value").alias("answer")), column))
        good = hit.where("error is null").drop("answer", "error")
        out = good if out is None else out.unionByName(good)
        left = left.join(good.select(column), column, "left_anti")
    return out.unionByName(left.withColumn("restored", F.lit(None).cast("string")))


def batches(df: DataFrame, doc: str, pos: str, size: str, *, key: str | None = None, items: int = ITEMS, limit: int = BYTES) -> DataFrame:
    """Fragments of a document in order, dealt into batches of at most items rows and limit bytes; none is split.

    A fragment above the limit has a batch of its own.  With key, one that the document had before
    costs nothing: it gets the batch of the first.  Documents are dealt to tasks by hash, sorted, and
    folded as they come, so a task holds one batch of rows and one document's keys.
    """
    rows = df.select(doc, pos, size, *([key] if key else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch_id, n, used, seen = None, 0, 0, 0, {}
        for part in parts:
            out = []
            docs, sizes = part.column(0).to_pylist(), part.column(2).to_pylist()
            names = part.column(3).to_pylist() if key else docs
            for d, b, k in zip(docs, sizes, names, strict=True):
                if d != now:
                    now, batch_id, n, used, seen = d, 0, 0, 0, {}
                if key and k in seen:
                    out.append(seen[k])
                    continue
                if n and (n >= items or used + b > limit):
                    batch_id, n, used = batch_id + 1, 0, 0
                n, used = n + 1, used + b
                if key:
                    seen[k] = batch_id
                out.append(batch_id)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], [*part.schema.names, "batch_id"])

    return rows.repartition(doc).sortWithinPartitions(doc, pos).mapInArrow(run, f"{kinds}, batch_id long")


def estimate(df: DataFrame, doc: str, pos: str, key: str, size: str, known: DataFrame | None = None) -> DataFrame:
    """One row: fragments that are not in the cache (known: key), each once, their input bytes, requests, and cache hits."""
    rows = df.select(doc, pos, key, size)
    hits = rows.join(known.select(key).distinct(), key, "left_semi") if known is not None else rows.where("false")
    left = rows.join(known.select(key).distinct(), key, "left_anti") if known is not None else rows
    first = left.groupBy(key).agg(F.min(F.struct(doc, pos, size)).alias("f")).select(key, "f.*")
    packed = batches(first, doc, pos, size)
    n = packed.agg(F.count("*").alias("n_fragments"), F.coalesce(F.sum(size), F.lit(0)).alias("input_bytes"), F.count_if(F.col(size) > BYTES).alias("n_oversize"), F.count_distinct(doc, "batch_id").alias("n_requests"))
    return n.join(F.broadcast(hits.agg(F.count("*").alias("cache_hits"))), F.lit(True))


def answers(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(batch, id, a fragment's fields) with answer, restored and error, from replies(batch, reply: a JSON array).

    A reply holds one object {id, text} for each fragment asked, in order, and no other fields.  If
    anything in a reply is wrong, all fragments of its batch are refused: nothing of it is kept.
    """
    shape = replies.select("batch", F.when(F.col("reply").rlike(r"(?s)^\s*\[.*\]\s*$") & (F.octet_length("reply") <= ANSWER), F.from_json("reply", "array<map<string, string>>")).alias("rows"), F.from_json("reply", "array<struct<id: int, text: string>>").alias("typed"))
    rows = shape.select("batch", F.posexplode_outer(F.arrays_zip("rows", "typed")).alias("p", "r"))
    rows = rows.select("batch", (F.col("p") + 1).alias("id"), F.col("r.typed.text").alias("answer"), (F.array_sort(F.map_keys("r.rows")) == F.array(F.lit("id"), F.lit("text"))) & (F.col("r.typed.id") == F.col("p") + 1))
    rows = rows.toDF("batch", "id", "answer", "fits").where("id is not null")
    both = asked.withColumn("_asked", F.lit(True)).join(rows, ["batch", "id"], "full_outer")
    whole = both.groupBy("batch").agg(F.min(F.coalesce("_asked", F.lit(False)) & F.coalesce("fits", F.lit(False)) & F.col("answer").isNotNull()).alias("whole"))
    known = validated(both.where("_asked").drop("_asked", "fits"))
    bad = known.groupBy("batch").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    out = known.join(whole, "batch").join(bad, "batch")
    error = F.when(~F.col("whole"), "shape").when(F.col("error").isNotNull(), F.col("error")).when(F.col("bad"), "batch")
    return out.withColumns({"error": error, "restored": F.when(error.isNull(), F.col("restored"))}).drop("whole", "bad")


def ledger(requests: DataFrame, *, max_requests: int, max_input_bytes: int, max_wire_bytes: int) -> DataFrame:
    """requests(run, pos, input_bytes, wire_bytes) with the sums so far and sent: those before the first that would break a limit.

    A body above BODY bytes breaks one, too.  A run's requests are few (max_requests is 1,000 at most).
    """
    by = Window.partitionBy("run").orderBy("pos")
    rows = requests.withColumns({"n": F.row_number().over(by), "input_sum": F.sum("input_bytes").over(by), "wire_sum": F.sum("wire_bytes").over(by)})
    bad = (F.col("n") > max_requests) | (F.col("input_sum") > max_input_bytes) | (F.col("wire_sum") > max_wire_bytes) | (F.col("wire_bytes") > BODY)
    return rows.withColumn("sent", F.max(bad).over(by) == F.lit(False))


def translate(plan: list[dict], call: Callable[[list[dict]], str]) -> list[dict]:
    """Calls an injected model for batches {batch, items} of the driver, in order, until one fails; each gets reply or error."""
    out, stopped = [], None
    for b in plan:
        if stopped:
            out.append(b | {"error": stopped})
            continue
        try:
            out.append(b | {"reply": call(b["items"])})
        except Exception as e:  # noqa: BLE001  an injected function may raise anything; the session ends
            stopped = str(e) or type(e).__name__
            out.append(b | {"error": stopped})
    return out


def planned(pages: DataFrame, key: str, html: str, caches: list[DataFrame], make_key: Callable[[Column], Column], size: int = PIECE) -> DataFrame:
    """The nodes of pages, long texts in pieces: key, pos, kind, text, k (its cache key), needs, and done, what stands in its place.

    Tags, blanks and text that needs no language stand for themselves; other text for its first good
    answer in the caches, newest first; done is null where there is none.
    """
    rows = html_pieces(pages, key, html, size)
    texts = rows.where("kind = 'text'").withColumn("k", make_key(F.col("text")))
    frag = fragments(texts, [key, "pos", "kind", "text", "k"])
    need = F.col("requires_language") & (F.trim("text") != "")
    got = cached(frag.where(need), [("k", c) for c in caches]) if caches else frag.where(need).withColumn("restored", F.lit(None).cast("string"))
    cols = [key, "pos", "kind", "text", "k"]
    out = got.select(*cols, F.lit(True).alias("needs"), F.col("restored").alias("done")).union(frag.where(~need).select(*cols, F.lit(False), "text"))
    return out.union(rows.where("kind <> 'text'").select(key, "pos", "kind", "text", F.lit(None).cast("string"), F.lit(False), F.when(F.col("kind") == "tag", F.col("text"))))


def translated(plan: DataFrame, key: str) -> DataFrame:
    """key and html of planned nodes: tags byte for byte, texts by their answers; null where one is missing, or the page was refused."""
    return assembled(plan, key, "done")


#: What tokens() takes for a unit: URLs, entities, anything with a digit, financial symbols.
UNIT = r"https?://[^\s<>]+|&[A-Za-z]+;|&#[0-9]+;|[^\s]*[0-9][^\s]*|[$€£¥%]"


def tokens(text: Column) -> Column:
    """The units of a text by one pattern, as an expression: a quick view without placeholders."""
    return F.regexp_extract_all(text, F.lit(f"({UNIT})"), 1)
