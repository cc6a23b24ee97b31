"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import chat_format, jaccard_join, language_id, mixing, packing, quality_rules, rolling_windows, source_divergence, suffix_dedup, token_counts, toxicity, url_filter, vector_search
from sedimenta.llm.tables import bounded_batches, read, remainder

#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 1024


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.judge(docs, labels).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    counted = token_counts.count_tokens(
        read(spark, sf_dir, "documents", "doc_id", "text"), token_counts.session_cache(spark), files.path("byte_bpe_50k.json"),
        ranks_path=files.path("byte_bpe_50k.tiktoken"), pattern=files.PATTERN, specials={"<|endoftext|>": 50256},
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages", "page_id", "url"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.withColumns({"held_out": remainder() == 2, "predicted": (F.col("score") >= 0.3).cast("int")})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs)).withColumn("held_out", remainder() == 2)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_windows.features(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


#: A conversation whose texts hold control strings, formatted with the others.
ODD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.expanded(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(odd)))


def _prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _prepared(f)
    for f in (
        op1_quality_rules, op2_token_counts, op3_packing, op4_vector_search, op5_url_filter,
        op6_mixing, op7_toxicity, op8_language_id, op9_suffix_dedup, op10_jaccard_join,
        op11_source_divergence, op12_rolling_windows, op13_chat_format,
    )
}

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SHARE = "1 + ({n}::hugeint + 1) * 1000000000 // ({total}::hugeint + {terms})"

#: CRC-32 of the bytes of a number's digits: eight steps for each byte, from all ones, and inverted at the end.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)))"""

#: Characters that the template puts around and into a turn.
_ADDED = r"""case role when 'user' then 15 when 'assistant' then 5 when 'system' then 15 else 20 + length(role) end
 + len(regexp_extract_all(text, '<\\*</SYS>>|<\\*<SYS>>|\[\\*/INST\]|\[\\*/ROLE\]|\[\\*/TURN\]|\[\\*INST\]|\[\\*ROLE\]|<\\*/s>|<\\*s>'))"""

ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": rf"""with d as (select coalesce(lang, '') lang, coalesce(source, '') source, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') t, row_number() over () r from documents),
 e as (select lang, source, r, unnest(t) term from d), k as (select lang, term, count(*) n from e group by 1, 2 having count(distinct r) >= 3), g as (select distinct lang, source from d), l as (select lang, count(*) v, sum(n) total from k group by 1),
 c as (select e.lang, e.source, e.term, count(*) n from e join k on k.lang = e.lang and k.term = e.term group by 1, 2, 3), s as (select lang, source, sum(n) total from c group by 1, 2),
 x as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, {_SHARE.format(n="coalesce(c.n, 0)", total="coalesce(s.total, 0)", terms="l.v")} p, {_SHARE.format(n="k.n", total="l.total", terms="l.v")} q from g join k on k.lang = g.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join s on s.lang = g.lang and s.source = g.source),
 f as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) v from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
 o as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f.v, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
 union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from x where n > 0 and p > q)
 select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as "rank" from o qualify part = 'pair' or "rank" <= 200""",
    "op12_rolling_windows": f"""with e as (select doc_id, source, lang, length(text) n, 60 * ((doc_id + {_CRC} % 10000) // 6) event_s from documents), w as (
 select doc_id, 600::bigint window_s, event_s, count(*) over w n_events, coalesce(sum(n) over w, 0)::bigint sum_chars, len(list_distinct(list(lang) over w))::bigint n_langs, list_sort(list_filter(list(n) over w, lambda x: x is not null)) x from e window w as (partition by source order by event_s range between 600 preceding and 1 preceding)
 union all select doc_id, 43200, event_s, count(*) over w, coalesce(sum(n) over w, 0)::bigint, len(list_distinct(list(lang) over w))::bigint, list_sort(list_filter(list(n) over w, lambda x: x is not null)) from e window w as (partition by source order by event_s range between 43200 preceding and 1 preceding))
 select doc_id, window_s, event_s, n_events, sum_chars, coalesce(n_langs, 0) n_langs, x[(len(x) + 1) // 2] median_chars, x[(90 * len(x) + 99) // 100] high_chars from w""",
    "op13_chat_format": f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
 f as (select *, length(text) + {_ADDED} n from c), p as (select *, sum(n) over (partition by conv_id order by turn, role, text) upto from f)
 select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
 sum(n)::bigint formatted_chars, count(*) filter (role = 'assistant') n_examples, coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint expanded_chars from p group by 1""",
}
