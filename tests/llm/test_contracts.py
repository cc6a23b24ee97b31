"""The registered queries over the smallest tables against plain code, in all columns that are not learned."""

import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_op1(spark, documents):
    from sedimenta.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op1_quality_rules"](spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        w = WORD.findall(d["text"] or "")
        lines = [x for x in (d["text"] or "").split("\n") if WORD.search(x)]
        three: dict = {}
        for i in range(len(w) - 2):
            three.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {i + k for at in three.values() if len(at) > 1 for i in at for k in range(3)}
        r = got[d["doc_id"]]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d["text"] or "")), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_op2(spark, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from sedimenta.llm.queries import QUERIES

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    n = {d["doc_id"]: len(tok.encode(d["text"] or "", add_special_tokens=False).ids) for d in documents}
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()), n[d["doc_id"]], n[d["doc_id"]] > 1024) for d in documents}


def test_op5(spark):
    from sedimenta.llm.queries import QUERIES
    from sedimenta.llm.url_filter import RULES, judge

    def cut(url):
        _, found, rest = (url or "").partition("://")
        host = re.split("[/?#]", rest)[0] if found else ""
        path = re.split("[?#]", rest[len(host) :])[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), path

    def rule(host, path):
        fit = [r for r, _ in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=len, default=None)

    odd = ["http://É.COM/a", "x://", "://a.com/b", "http://example.com", "http://example.com/en", "http://EXAMPLE.com/en/", "http://a.www.example.com/en/?x", "http://notexample.com/en/", "ftp://u@x.net:80/fr/#", "http://a?b/c", "http://a#b://c/d", "a://b://c/d", "http://x.net/es/\n2", "", None, "http://net/fr/"]
    for df, urls in ((QUERIES["op5_url_filter"](spark, SF), {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}), (judge(spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")), dict(enumerate(odd)))):
        got = {r["page_id"]: r for r in df.collect()}
        assert set(got) == set(urls)
        for k, url in urls.items():
            host, path = cut(url)
            own = rule(host, path)
            assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, own)
            assert got[k]["verdict"] in ("allow", "block") and (own is None or got[k]["verdict"] == dict(RULES)[own])


@pytest.mark.parametrize("name, extra", [("op7_toxicity", "predicted"), ("op8_language_id", "lang_pred")])
def test_learned_queries_keep_their_contract(spark, documents, name, extra):
    from sedimenta.llm.queries import QUERIES

    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in documents)
    text = {d["doc_id"]: d["text"] for d in documents}
    langs = {d["lang"] for d in documents} | {"und"}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r[extra] == int(r["score"] >= 0.3) if name == "op7_toxicity" else r[extra] in langs
        if name == "op8_language_id":
            assert (r[extra] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or ""))
