"""Winners by shared neighbours, every other src being a candidate."""

from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from quire.operators import joins as jon
from quire.queries import QUERIES

EDGES = [(0, 1), (0, 2), (0, 2), (1, 1), (1, 2), (2, 2), (3, 9), (20, 5), (20, 6), (21, 5), (22, 6), (40, 77), (None, 1), (5, None)]


def test_winners_equal_brute_force(spark):
    out = jon.shared_with_all(spark.createDataFrame(EDGES, "src long, dst long"), F.col("src") % 20 == 0).collect()
    edges = {e for e in EDGES if None not in e}
    counts = Counter((a, b) for (a, x), (b, y) in product(edges, edges) if x == y and a != b and a % 20 == 0)
    want = set()
    for m in {a for a, _ in counts}:
        (n, b), *rest = sorted(((n, b) for (a, b), n in counts.items() if a == m), reverse=True)
        if not rest or rest[0][0] < n:
            want.add((m, b, n))
    assert {(r.mention_id, r.candidate, r["count"]) for r in out} == want and len(out) == len(want) == 1


def test_pairs_meet_once(spark):
    """Pairs of mention and candidate are counted where they meet, and not met with all neighbours of either again."""
    plan = QUERIES["shared_neighbour_winner"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
