"""What classifiers learn from: whole texts, or pieces from all over long ones."""

from pyspark.sql import functions as F

from sedimenta.llm import language_id
from sedimenta.llm.tables import pieces


def test_pieces(spark):
    text = "".join(chr(0x4E00 + k) for k in range(1000))
    df = spark.createDataFrame([(k, text[:n]) for k, n in enumerate([0, 99, 100, 101, 537, 1000])], "k int, text string").union(spark.createDataFrame([(6, None)], "k int, text string"))
    got = {r["k"]: r["p"] for r in df.select("k", pieces(F.col("text"), F.col("k"), 100, 4, "|").alias("p")).collect()}
    assert [got[k] for k in (0, 1, 2, 6)] == ["", text[:99], text[:100], None]
    for k, n in ((3, 101), (4, 537), (5, 1000)):
        parts = got[k].split("|")
        assert [len(p) for p in parts] == [25] * 4
        for j, p in enumerate(parts):
            assert j * (n // 4) <= text.index(p) <= (j + 1) * (n // 4) - 25
    assert got[5] != "|".join(text[j * 25 : j * 25 + 25] for j in range(4))


def test_languages_of_texts_that_begin_with_none(spark):
    """The words of each language stand behind 30,000 characters that belong to no word."""
    words = {"aa": "brelto vunka sirpel mostig", "bb": "quinzat ohrewy dapfu xelmo"}
    rows = [(k, "1234567890 " * 3000 + (words[lang] + " ") * 1200, lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(docs)
    new = spark.createDataFrame([(100, words["aa"]), (101, words["bb"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(new, filters).collect()}
    assert got[100][0] == "aa" and got[101][0] == "bb" and min(s for _, s in got.values()) > 0.5
