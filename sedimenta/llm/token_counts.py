"""Token counts through a digest cache.

A text's count depends on its content and on the tokenizer's version only, so counts are stored
under (digest of the normalised text, digest of the tokenizer file).  A run joins its texts'
digests to the cache, encodes each distinct missing text once, appends the new counts to the
cache, and joins all documents to it.  Normalisation turns null into the empty text.

Copies are dropped inside each task before the shuffle, so one hot text reaches a reducer at most
once per task.  The cache is a Parquet folder; appending is a Spark write, so a lost executor
leaves no partial counts, and counts written twice by concurrent runs are equal and folded on
reading.  Null texts count as empty (zero tokens); repeated rows are each returned.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.blocks import blocks
from sedimenta.llm.tables import shared_folder, written

#: Texts that a worker encodes at once.
ENCODE_ROWS = 64
#: Texts with characters beyond Latin letters go to the reference encoder, whose Unicode tables decide.
PLAIN = re.compile("[\x00-ɏ‐-‧€]*")


def version(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None, specials: dict[str, int] | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, as the file's own library gives them.

    ranks_path may name the same vocabulary as ranks: plain texts are then encoded by the faster
    library, which gives the same tokens.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    slow = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if ranks_path is None:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials or {})
    return lambda texts: [len(fast.encode(t, allowed_special="all")) if PLAIN.fullmatch(t) else slow([t])[0] for t in texts]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose digest (column 0) is new in this task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(k)
        if keep:
            yield batch.take(pa.array(keep))


def count_tokens(docs: DataFrame, cache: str, path: str, *, ranks_path: str | None = None, pattern: str | None = None, specials: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row's whole text; new counts are appended to the cache folder."""
    spark, tag = docs.sparkSession, version(path)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    schema = "digest binary, n_tokens long, version string"
    stored = lambda: spark.read.schema(schema).parquet(cache).where(F.col("version") == tag).select("digest", "n_tokens")
    missing = source.select("digest", "text").mapInArrow(_firsts, "digest binary, text string")
    if _exists(spark, cache):
        missing = missing.join(stored(), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in _firsts(batches):
            count = count or encoder(path, ranks_path, pattern, specials)
            for b in blocks(batch.column(1)):
                part = batch.slice(b.first, b.n)
                for k in range(0, part.num_rows, ENCODE_ROWS):
                    some = part.slice(k, ENCODE_ROWS)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(count(some.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    fresh = missing.repartition("digest").mapInArrow(encode, "digest binary, n_tokens long")
    fresh.withColumn("version", F.lit(tag)).write.mode("append").parquet(cache)
    # as a table, so that the join below reads it straight and a digest of many copies can be split over tasks
    known = written(stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    narrow = source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return narrow.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and len(fs.listStatus(path)) > 0


def session_cache(spark: SparkSession) -> str:
    """The cache folder that the setting sedimenta.token.cache names, which lasts between runs; else a new one."""
    return spark.conf.get("sedimenta.token.cache", None) or f"{shared_folder(spark)}-token-cache"
