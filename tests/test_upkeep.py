"""State that is revised, subscriptions removed and found, and a reader's place after a rebuild."""

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import books, library
from sedimenta.sources.state import Versions

SNAPSHOT = "book int, metadata map<string, string>, old_chars long, old_size long, new_chars long, new_size long"


def test_restored_progress(spark):
    """A share of the old text in the new one; unknown lengths and places open the book at its start."""
    read = {"last_percent": "0.4", "font": "a", "bookmarks": "b", "stats": "s"}
    rows = [(1, read, 60, None, 100, None), (2, read, 100, None, 60, None), (3, read, None, 50, None, 200), (4, read, None, None, 100, None), (5, {"font": "a"}, 60, None, 100, None), (6, {"last_percent": "x"}, 60, None, 100, None), (7, None, 60, None, 100, None), (8, read, 60, None, 0, None), (9, {"last_percent": "0"}, 6, None, 9, None)]
    df = spark.createDataFrame(rows, SNAPSHOT)
    got = {r["book"]: r for r in books.restored_progress(df, "shift").collect()}
    assert {k: r["policy"] for k, r in got.items()} == {k: "shift" if k < 4 else "reset" for k in range(1, 10)}
    for k, want in {1: 0.4 + 0.4 * 0.6, 2: 0.4, 3: 0.75 + 0.4 * 0.25}.items():
        assert got[k]["shifted"] == pytest.approx(want) and got[k]["metadata"] == {"font": "a", "last_percent": str(got[k]["shifted"]), "percent_finished": str(got[k]["shifted"])}
    assert got[4]["metadata"] == got[5]["metadata"] == {"font": "a"} and got[7]["metadata"] == {}
    again = books.restored_progress(df, notes=True).where("book = 1").first()
    assert (again["policy"], again["shifted"], again["metadata"]) == ("reset", None, {"font": "a", "bookmarks": "b"})
    assert books.restored_progress(df.limit(0), "shift").count() == 0
    with pytest.raises(ValueError):
        books.restored_progress(df, "keep")


def test_removed_and_found(spark):
    entries = spark.createDataFrame([("0000000001", "x"), ("0000000002", None), (None, "z")], "cik string, outcome_note string")
    keys = spark.createDataFrame([("0000000002",), ("0000000002",), ("0000000009",), (None,)], "cik string")
    got = {(r["cik"], r["outcome_note"], r["outcome"]) for r in library.removed(entries, "cik", keys).collect()}
    assert got == {("0000000001", "x", "kept"), ("0000000002", None, "removed"), (None, "z", "kept"), ("0000000009", None, "absent")}
    assert library.removed(entries, "cik", keys.limit(0)).where("outcome = 'kept'").count() == 3
    asked = spark.createDataFrame([(1, "CIK 1"), (2, "0000000001"), (3, "2"), (4, "77"), (5, "no"), (6, None)], "n int, said string")
    rows = {r["n"]: (r["cik"], r["entry"] and r["entry"]["outcome_note"]) for r in library.found(entries, asked, "said").collect()}
    assert rows[1] == rows[2] == ("0000000001", "x") and rows[3] == ("0000000002", None) and rows[4] == ("0000000077", None)
    assert rows[5] == rows[6] == (None, None)


def test_revision_is_refused_where_the_state_was_not_seen(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "s"))
    more = lambda df: spark.range(2) if df is None else df.union(df)
    assert v.revise(more) is None and v.revise(more) is None and v.load().count() == 4
    assert v.revise(more, lambda df: "no") == "no" and v.load().count() == 4
    newest = tmp_path / "s" / v.info()["name"]
    for f in newest.glob("*"):
        f.unlink()
    assert v.revise(more) == "the newest version cannot be read" and v.info()["name"] == newest.name and v.load().count() == 2
    assert v.revise(more, adopt=True) is None and v.load().count() == 4
    (tmp_path / "s" / ".current.json.crc").unlink(missing_ok=True)
    (tmp_path / "s" / "current.json").write_text("[{")
    assert v.revise(more) == v.revise(more, adopt=True) == "the pointer cannot be read"
    assert (tmp_path / "s" / "current.json").read_text() == "[{"
