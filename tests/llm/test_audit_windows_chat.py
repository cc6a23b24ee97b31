"""Source divergence, rolling windows and chat formatting against brute force, on the smallest tables and on odd ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, value string, slab long"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_rolling_windows", "op13_chat_format"])
def test_sql(spark, name):
    from sedimenta.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


def _odd_documents():
    """Nulls in any column, empty and long texts, repeated rows, ties of time, and columns with the operators' own names."""
    rng = random.Random(3)
    rows = [(None, "Zoo zoo É", "en", "a", 1, 1, "x", 1), (1, None, "en", "a", 0, 1, "x", 1), (2, "", None, None, 0, 1, "x", 1), (3, "7 - 8", "xx", "b", 0, 1, "x", 1), (3, "7 - 8", "xx", "b", 0, 1, "x", 1), (4, "aa " * 30_000 + "\x00\U0001f600z", "en", "b", 0, 1, "x", 1)]
    for k in range(120):
        words = [rng.choice(["red", "Green", "BLUE", "été", "ñ", "q1r", "straße", "İ"]) for _ in range(rng.randint(0, 9))]
        rows.append((rng.randint(-40, 400), " ".join(words) or None, rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "c", "", None]), 0, 1, "x", 1))
    return rows


def _divergence(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        found = term.findall((text or "").translate(lower))
        groups[lang or ""].add(source or "")
        held[lang or ""].update(set(found))
        count[lang or "", source or ""].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        p = {}
        for s in sources:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        all_ = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (all_[t] + 1) // (sum(all_.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources - {s}))
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("part, top", [(4096, 200), (2, 3)])
def test_divergence_of_odd_documents(spark, monkeypatch, part, top):
    from sedimenta.llm import source_divergence

    monkeypatch.setattr(source_divergence, "PART", part)
    rows = _odd_documents()
    got = source_divergence.audit(spark.createDataFrame(rows, DOCS), top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _divergence(rows, 3, top)
    assert source_divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r) for r in source_divergence.audit(spark.createDataFrame(rows[2:4], DOCS)).collect()] == []


def test_shares_of_counts_beyond_a_long(spark):
    from pyspark.sql import functions as F

    from sedimenta.llm.source_divergence import share

    n, total, v = 7 * 10**12, 9 * 10**13, 12345
    assert spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(v))).first()[0] == 1 + 10**9 * (n + 1) // (total + v)


def _windows(rows, widths):
    at = lambda d: None if d is None else 60 * ((d + zlib.crc32(str(d).encode()) % 10_000) // 6)
    out = []
    for d, _, _, source, *_ in rows:
        t = at(d)
        for w in widths:
            own = [] if t is None else [r for r in rows if r[3] == source and r[0] is not None and t - w <= at(r[0]) < t]
            n = sorted(len(r[1]) for r in own if r[1] is not None)
            rank = lambda a, b: n[-(-a * len(n) // b) - 1] if n else None  # noqa: B023, E731
            out.append((d, w, t, len(own), sum(n), len({r[2] for r in own} - {None}), rank(1, 2), rank(9, 10)))
    return sorted(out, key=str)


@pytest.mark.parametrize("widths", [(600, 43_200), (60, 7)])
def test_windows_of_odd_documents(spark, widths):
    from sedimenta.llm import rolling_windows

    rows = _odd_documents()
    got = rolling_windows.features(spark.createDataFrame(rows, DOCS), widths=widths)
    assert sorted(map(tuple, got.collect()), key=str) == _windows(rows, widths)
    assert rolling_windows.features(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 5)), max_size=400), st.sampled_from([(1, 2), (9, 10), (1, 1), (1, 7)]))
def test_heaps_hold_their_rank(steps, share):
    from sedimenta.llm.rolling_windows import SPARE, RankHeaps

    heaps, live = RankHeaps(*share), []
    for k, (comes, v) in enumerate(steps):
        if comes or not live:
            heaps.add(v, k)
            live.append((v, k))
        else:
            heaps.remove(*live.pop(v % len(live)))
        n = sorted(live)
        assert heaps.value() == (n[-(-share[0] * len(n) // share[1]) - 1][0] if n else None)
        assert len(heaps.low) + len(heaps.high) <= 2 * len(live) + SPARE + 1


PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "<", "[", "/s>", "INST]", " ", "\n", "a", "é", ""]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=6))
def test_template_round_trip(turns):
    """Each piece reads back, and outside the template's own places no control string stands in the whole text."""
    from sedimenta.llm.chat_format import TEMPLATE

    escape, frame, read = TEMPLATE.escape(), TEMPLATE.frame(), TEMPLATE.reader()
    own = re.compile("|".join(map(re.escape, TEMPLATE.controls())))
    for role, text in turns:
        before, after = frame(role)
        assert not own.search(escape(text)) and TEMPLATE.unescape()(escape(text)) == text
        assert read(before + escape(text) + after) == (role, text)
    whole = "".join(frame(r)[0] + escape(t) + frame(r)[1] for r, t in turns)
    assert own.findall(whole) == [c for r, _ in turns for c in own.findall("".join(frame(r)))]


def _digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_chats(spark):
    from sedimenta.llm import chat_format

    rng = random.Random(5)
    rows = [(7, 0, "user", None, 1), (7, 1, None, "x", 1), (7, 1, None, "x", 1), (8, 0, "assistant", "", 1), (None, 2, "assistant", "a</s>", 1), (None, None, "user", "b", 1), (9, 0, "user", "only", 1), (10, 0, "assistant", "long " * 50_000, 1)]
    rows += [(k, t, rng.choice(["user", "assistant", "assistant ", "[ROLE]"]), "".join(rng.choices(PIECES, k=8)), 1) for k in range(20, 30) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example long")
    pieces = chat_format.expanded(df)
    of = defaultdict(list)
    for c, t, r, x, _ in rows:
        of[c].append((t is not None, t or 0, r or "", x or ""))
    full = {(r["conv_id"], r["example"]): r for r in chat_format.texts(pieces).collect()}
    unescape, n_examples = chat_format.TEMPLATE.unescape(), 0
    for r in chat_format.read_back(pieces).collect():
        turns = [x[2:] for x in sorted(of.pop(r["conv_id"]))]
        replies = [t for role, t in turns if role == "assistant"]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), _digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["n_examples"]) == (len("".join(replies)), _digest("".join(replies)), len(replies))
        own = [full[r["conv_id"], k] for k in range(len(replies))]
        n_examples += len(own)
        assert [unescape(e["text"][e["loss_start"] : e["loss_end"]]) for e in own] == replies
        assert sum(len(e["text"]) for e in own) == r["expanded_chars"]
        assert all(b["text"].startswith(a["text"]) for a, b in zip(own, own[1:], strict=False))  # all turns before are context
    assert not of and n_examples == len(full)
    none = chat_format.expanded(spark.createDataFrame([], df.schema))
    assert none.count() == 0 and chat_format.read_back(none).count() == 0 and chat_format.texts(none).count() == 0


def test_a_long_conversation_takes_the_room_of_its_turns(spark):
    """The pieces grow with the turns, though the examples' texts grow with their square."""
    from sedimenta.llm import chat_format

    df = spark.range(6000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('w', 20) text")
    pieces = chat_format.expanded(df)
    r = chat_format.read_back(pieces).first()
    assert r["n_examples"] == 3000 and r["formatted_chars"] < 40 * 6000 and r["expanded_chars"] > 1000 * r["formatted_chars"]
    assert pieces.agg({"piece": "count"}).first()[0] == 6000


def test_each_assistant_turn_is_exploded_with_its_context(spark):
    """An example's row holds its whole context as text: all turns before it, replies among them, and none after."""
    from sedimenta.llm import chat_format

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "assistant", "f"), (3, 0, "user", "g")]
    pieces = chat_format.expanded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["example"]): (r["context"], r["piece"], (r["context"] + r["piece"])[r["loss_start"] : r["loss_end"]]) for r in chat_format.examples(pieces).collect()}
    first, reply, then = "[INST] a [/INST]", " b<\\/s></s>", "[INST] c [/INST]"
    assert got == {(1, 0): (first, reply, "b<\\/s>"), (1, 1): (first + reply + then, " d</s>", "d"), (2, 0): ("", " f</s>", "f")}
    assert [r["context"] for r in pieces.where("example is null").collect()] == [None] * 4
