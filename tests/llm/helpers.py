"""Rows that every operator must stand: nulls, empty and long texts, repeats, shared ids, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None, sources=None):
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    rows = [(ids[i], texts[i], (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(texts[i] or "")) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return (text or "").encode().split()


PASSAGE = " ".join(f"w{i}" for i in range(30))
ODD = [None, "", "   \n\t ", "one", "a b c", PASSAGE, PASSAGE, "x " + PASSAGE + " y", "a " * 3000, "é" * 5000, "z" * 100000, " ".join(f"q{i}" for i in range(20000))]
