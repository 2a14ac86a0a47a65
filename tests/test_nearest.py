"""The nearest documents by blocks, against V.cosine for every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import vectors as V
from quire.operators import recommend as rec


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_equal_all_pairs(spark, block):
    """Bit for bit: copies, short, empty and null vectors, nulls within, extreme lengths."""
    rng = np.random.default_rng(3)
    odd = [[0.0] * 6, [], None, [1.0, None, 2.0, 0.0, 0.0, 0.0], [1.0, 2.0], [1e-200] * 6, [1e200] * 6, [math.nan] * 6, [1.0] * 9]
    plain = [rng.normal(size=6).tolist() for _ in range(30)]
    docs = list(enumerate(plain + plain[:5] * 6 + odd + odd))
    users = list(enumerate([rng.normal(size=6).tolist() for _ in range(20)] + [plain[0], [0.0] * 6, [1.0, 1.0], [1e-200] * 6, [1e150] * 6]))
    points = spark.createDataFrame(users, "user_id long, centroid array<double>")
    vectors = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    seen = spark.createDataFrame([(u, d) for u, _ in users for d in rng.choice(90, u % 4, replace=False).tolist()] + [(3, 5000)], "user_id long, doc_id long")
    every = points.crossJoin(vectors).join(seen, ["user_id", "doc_id"], "left_anti").select("user_id", "doc_id", ((1 + V.cosine("centroid", "embedding")) / 2).alias("semantic")).collect()
    for k in (1, 8, 200):
        want = {}
        for u, _ in users:
            own = sorted((-r.semantic, r.doc_id) for r in every if r.user_id == u)
            want[u] = [(d, -s) for s, d in own[:k]]
        got = {u: [] for u, _ in users}
        for r in rec.nearest(points, vectors, seen, k, block).orderBy("user_id", F.desc("semantic"), "doc_id").collect():
            got[r.user_id].append((r.doc_id, r.semantic))
        assert got == want
