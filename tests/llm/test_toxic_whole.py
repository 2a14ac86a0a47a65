"""The classifier learns from every labelled row that it may learn from."""

import numpy as np
import pytest

from quire.llm import toxicity

from .helpers import documents


@pytest.mark.parametrize("few", [10**6, 0])
def test_all_rows_are_learnt(spark, monkeypatch, few):
    """Both ways of training hold every row: a word in a single document of each part changes its embedding."""
    monkeypatch.setattr(toxicity, "FEW", few)
    monkeypatch.setattr(toxicity, "SHARE", 50)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "STEPS", 20)
    if hasattr(toxicity, "MOST"):
        monkeypatch.setattr(toxicity, "MOST", {0: 60, 1: 30})  # as bounds were
    n = 400
    docs = documents(spark, [f"w{i} plain text" + " vile" * (i % 3 == 0) for i in range(n)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    net, limits = toxicity.fit(docs, labels)
    start = toxicity.Net().p["e"]
    moved = lambda i: (net.p["e"][toxicity.tokens(docs_word(i))[0]] != start[toxicity.tokens(docs_word(i))[0]]).any()
    rows = labels.select("doc_id", toxicity.held_out().alias("away")).collect()
    learnt = sum(moved(r.doc_id) for r in rows if not r.away)
    assert learnt > 0.8 * sum(not r.away for r in rows)  # all but the tenth that calibrates
    assert sum(moved(r.doc_id) for r in rows if r.away) < 0.05 * n  # words that share a bucket
    out = {r.doc_id: r.predicted for r in toxicity.score(docs, (net, limits)).collect()}
    assert np.mean([out[i] == (i % 3 == 0) for i in range(n)]) > 0.9


def docs_word(i):
    import pyarrow as pa

    return pa.array([f"w{i}"])
