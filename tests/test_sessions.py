"""Translation sessions: budgets, kills at every point, repeated tasks, refused answers, and a second run that sends nothing."""

import json
import os

import pytest

from sedimenta.operators import fragments as f
from sedimenta.operators.sessions import Budget, Session
from sedimenta.sources import scratch


def _key(t):
    return f.cache_key(t, version="1", endpoint="e", model="m", thinking="off", language="zh-CN")


def _model(folder, fail=(), wrong=()):
    """A model that notes each call in a file of its own, fails for some texts and answers others wrongly."""
    from sedimenta.operators import fragments as f  # tasks cannot import this module

    def call(items):
        scratch.put(f"{folder}/calls", f"{os.getpid()}-{os.urandom(6).hex()}.json", json.dumps(items).encode())
        if any(x in i["text"] for i in items for x in fail):
            raise OSError("limit reached")
        if any(x in i["text"] for i in items for x in wrong):
            return "[]"
        return json.dumps([{"id": i["id"], "text": "译 " + " ".join(m[0] for m in f._MARK.finditer(i["text"]))} for i in items])

    return call


def _calls(folder):
    return [json.loads(open(f"{folder}/calls/{n}").read()) for n in scratch.names(f"{folder}/calls")]


def _pages(spark, n=6, texts=20):
    return spark.createDataFrame([(k, "".join(f"<p>Item {chr(97 + t)} of page {chr(65 + k)} rose {t}% since {'word ' * 12}</p>" for t in range(texts)) + "<b>$7</b>") for k in range(n)], "id long, html string")


def test_a_session_and_a_second_run(spark, tmp_path):
    pages, folder = _pages(spark), str(tmp_path / "s")
    s = Session(spark, folder, "id", _key, Budget(requests=50))
    rows = s.run(pages, _model(str(tmp_path))).collect()
    assert all(r["n_missing"] == 0 and r["html"].count("译") == 20 and r["failed"] == 0 for r in rows)
    calls = _calls(tmp_path)
    assert len(calls) == sum(r["requests"] for r in rows) and sum(len(i["text"].encode()) for c in calls for i in c) == sum(r["input_bytes"] for r in rows)
    assert all(len(c) <= f.ITEMS for c in calls)
    again = Session(spark, folder, "id", _key, Budget(requests=50)).run(pages, _model(str(tmp_path))).collect()
    assert len(_calls(tmp_path)) == len(calls) and sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_budgets_hold_over_sessions(spark, tmp_path):
    pages, folder = _pages(spark, 3), str(tmp_path / "s")
    for budget, most in ((Budget(requests=2), 2), (Budget(requests=2), 2), (Budget(requests=3, input_bytes=10**9), 3), (Budget(requests=99, input_bytes=1), 3)):
        rows = Session(spark, folder, "id", _key, budget).run(pages, _model(str(tmp_path))).collect()
        assert {r["requests"] for r in rows} == {most} and all((r["n_missing"] > 0) == (r["html"] is None) == (most < 3) for r in rows)
    assert len(_calls(tmp_path)) == 9
    wide = Session(spark, str(tmp_path / "t"), "id", _key, Budget(wire_bytes=1500))
    assert all(0 < r["wire_bytes"] <= 1500 for r in wide.run(pages, _model(str(tmp_path))).collect())


@pytest.mark.parametrize("point", ["reserved", "claimed", "replied", "cached"])
def test_a_killed_session_resumes(spark, tmp_path, point, monkeypatch):
    """Killed after the ledger, after some claims, after the replies, or between cache and outcomes: nothing is sent twice or over the budget."""
    pages, folder, budget = _pages(spark, 3), str(tmp_path / "s"), Budget(requests=6)
    s = Session(spark, folder, "id", _key, budget)
    attempts = [r["attempt"] for r in s.reserve(s.requests(s.plan(pages))).orderBy("run", "pos").collect()]
    lost = 0
    if point == "claimed":  # sent, perhaps, and never answered
        lost = 2
        assert all(scratch.created(f"{folder}/claims", a) for a in attempts[:lost]) and not scratch.created(f"{folder}/claims", attempts[0])
    if point in ("replied", "cached"):
        s.send(_model(str(tmp_path)))
    if point == "cached":
        with monkeypatch.context() as m:
            m.setattr(s.outcomes, "append", lambda df: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError, match="killed"):
                s.settle()
    before = len(_calls(tmp_path))
    rows = Session(spark, folder, "id", _key, budget).run(pages, _model(str(tmp_path))).collect()
    assert all(r["n_missing"] == 0 and r["requests"] <= 6 for r in rows)
    texts = [i["text"] for c in _calls(tmp_path) for i in c]
    assert len(texts) == len(set(texts)) == 60 and (before == len(attempts)) == (point in ("replied", "cached"))
    assert sum(r["requests"] for r in rows) == len(_calls(tmp_path)) + lost
    keys = [r["key"] for r in Session(spark, folder, "id", _key).cache.load().collect()]
    assert len(keys) == len(set(keys)) == 60


def test_failures_end_their_run_only(spark, tmp_path):
    pages, folder = _pages(spark, 3), str(tmp_path / "s")
    s = Session(spark, folder, "id", _key, Budget(requests=9))
    rows = {r["id"]: r for r in s.run(pages, _model(str(tmp_path), fail=["page A"], wrong=["page B"])).collect()}
    assert rows[2]["n_missing"] == 0 and rows[0]["n_missing"] == rows[1]["n_missing"] == 20
    per = {k: sum(f"page {x}" in c[0]["text"] for c in _calls(tmp_path)) for k, x in enumerate("ABC")}
    assert per[0] == 1 and rows[0]["failed"] >= 1 and rows[1]["failed"] == per[1]
    assert {r["outcome"] for r in s.outcomes.load().collect()} == {"ok", "limit reached", "shape"}
    rows = {r["id"]: r for r in s.run(pages, _model(str(tmp_path))).collect()}  # what was reserved behind the failure is sent now
    assert rows[0]["requests"] <= 9 and rows[0]["n_missing"] == 0


def test_no_pages(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"), "id", _key)
    none = spark.createDataFrame([], "id long, html string")
    assert s.run(none, _model(str(tmp_path))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "<script>x</script>"), (3, "<p>5 %</p>")], "id long, html string")
    assert {r["id"]: (r["html"], r["requests"]) for r in s.run(odd, _model(str(tmp_path))).collect()}[3] == ("<p>5 %</p>", 0) and not _calls(tmp_path)


def test_requests_of_conversations_by_brute_force(spark):
    from sedimenta.queries import QUERIES

    talks = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r["conv_id"], []).append(f"<p>{r['text'].replace('<', '')}</p>")
    want = []
    for k, parts in talks.items():
        found, pos, batch, spent = {}, 0, [], 0
        out = []
        for kind, x in f.nodes("".join(parts)):
            for piece in f.pieces(x) if kind == "text" else [x]:
                if kind == "text" and piece not in found and f.protect(piece.strip())[2] and piece.strip():
                    found[piece] = (pos, f.protect(piece.strip())[0])
                pos += 1
        for at, protected in found.values():
            n = len(protected.encode())
            if batch and (len(batch) >= f.ITEMS or spent + n > f.BYTES):
                out.append(batch)
                batch, spent = [], 0
            batch.append((at, protected, n))
            spent += n
        out += [batch] if batch else []
        wires = [len(json.dumps([{"id": i, "text": p} for i, (_, p, _) in enumerate(b, 1)], ensure_ascii=False, separators=(",", ":")).encode()) + 200 for b in out]
        bad = False
        for n, b in enumerate(out, 1):
            bad = bad or n > 2 or sum(x[2] for c in out[:n] for x in c) > 1500 or sum(wires[:n]) > 2500 or wires[n - 1] > f.BODY
            want.append((str(k), b[0][0], len(b), sum(x[2] for x in b), wires[n - 1], not bad))
    got = QUERIES["translation_requests"](spark, "/root/testdata/sf0.001").select("run", "pos", "n_items", "input_bytes", "wire_bytes", "reserved").collect()
    assert sorted(map(tuple, got)) == sorted(want)
