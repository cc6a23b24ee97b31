"""The corpus pipeline: each stage keeps all columns whatever their names, and does what brute force does on its own input."""

import random
import re

import pytest

WORD = r"[^\x20\x09-\x0D]+"
CLASH = ["id", "spans", "cut_id", "text_id", "check", "own", "row", "cut", "gone_id", "mix_id", "mix_at", "at", "u", "copy", "size", "place", "component_id", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(0, None), (1, ""), (2, "one two")]
    for d in range(3, 60):
        text = " ".join(word() for _ in range(80))
        rows.append((d, f"{text} {passage} {word()}" if d % 4 == 0 else text))
    rows += [(100 + k, rows[5 + k][1]) for k in range(10)]  # exact copies
    rows += [(200 + k, rows[20 + k][1] + " more") for k in range(10)]  # near copies
    rows += [(None, rows[30][1]), (300, rows[31][1]), (300, rows[31][1])]
    table = spark.createDataFrame([(d, t, "en", "ab"[(d or 0) % 2], None if t is None else len(t), *(f"{c}{d}" for c in CLASH)) for d, t in rows], ["doc_id", "text", "lang", "source", "n_chars", *CLASH])
    return table.repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_columns(spark, docs):
    import corpus_pipeline as p

    kept = p.distinct(spark, docs, "")
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert not {d for d in ids if d is not None and (100 <= d < 110 or 200 <= d < 210)} and None in ids and {0, 1, 2} <= set(ids)
    every = {r: n for n, r in enumerate(rows_of(docs))}
    assert all(r in every for r in rows_of(kept))

    cut = p.unrepeated(spark, kept, "")
    assert cut.columns == docs.columns
    before = {r["doc_id"]: r for r in kept.collect()}
    seen, text = set(), {}
    for d, r in sorted(before.items(), key=lambda x: (x[0] is None, x[0])):
        raw = (r["text"] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        text[d] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode()
    after = {r["doc_id"]: r for r in cut.collect()}
    assert set(after) == {d for d, r in before.items() if text[d] or not r["text"]} and any(text[d] != (before[d]["text"] or "") for d in after)
    for d, r in after.items():
        assert r["text"] == (text[d] if before[d]["text"] is not None else None) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert all(r[c] == before[d][c] for c in ["doc_id", "lang", "source", *CLASH])

    mix = p.mixed(spark, cut, "").cache()
    assert mix.columns == [*docs.columns, p.POSITION]
    at = [r[p.POSITION] for r in mix.collect()]
    assert at == sorted(at) and all(tuple(r)[:-1] in {tuple(x) for x in cut.collect()} for r in mix.collect())
    total = sum(len(re.findall(WORD, r["text"] or "")) for r in cut.collect())
    assert abs(sum(len(re.findall(WORD, r["text"])) for r in mix.collect()) - 1.5 * total) < 400

    packed = p.packed(spark, mix, "")
    per: dict = {}
    for r in packed.collect():
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["n_tokens"]
    want: dict = {}
    for r in mix.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(re.findall(WORD, r["text"]))
    assert per == want


def test_toxic_documents_go(spark):
    """The first stage: rows stay whole, what the labels call clean stays, what they call toxic goes."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumnRenamed("n_chars", "score")
    kept = p.clean(spark, docs, "/root/testdata/sf0.1")
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    known = {r["doc_id"] for r in docs.select("doc_id").collect()} & set(labels)
    toxic = [d for d in known if labels[d]]
    assert sum(d in left for d in toxic) < 0.1 * len(toxic) and sum(d in left for d in known if not labels[d]) > 0.97 * (len(known) - len(toxic))


def test_run(spark):
    import corpus_pipeline as p

    assert [name for name, _ in p.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "mixing", "packing"]
    got = p.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got and {r["doc_id"] for r in got} <= ids and all(r["n_tokens"] <= 2048 for r in got)
    bins: dict = {}
    for r in got:
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(bins.values()) <= 2048


def test_token_cache_lasts(spark, tmp_path, monkeypatch):
    """A second run of the query finds all counts in the cache and encodes nothing."""
    from sedimenta.llm import queries, token_counts

    spark.conf.set("sedimenta.token.cache", str(tmp_path / "cache"))
    try:
        first = rows_of(queries.op2_token_counts(spark, "/root/testdata/sf0.001"))
        n = spark.read.parquet(str(tmp_path / "cache")).count()
        monkeypatch.setattr(token_counts, "encoder", lambda *a, **k: 1 / 0)
        assert rows_of(queries.op2_token_counts(spark, "/root/testdata/sf0.001")) == first
        assert spark.read.parquet(str(tmp_path / "cache")).count() == n > 0
    finally:
        spark.conf.unset("sedimenta.token.cache")
