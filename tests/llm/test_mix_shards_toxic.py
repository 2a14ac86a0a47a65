import zlib
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import kd_shards, mixing, toxicity

from .helpers import ODD, by_id, documents, words

SF, SF01, SF1 = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def brute_rake(cells, rounds=mixing.ROUNDS):
    """Raking over a dictionary of (source, lang, topic) -> tokens."""
    total, w = sum(cells.values()), dict(cells)
    goals = []
    for d in range(3):
        sums = defaultdict(float)
        for c, t in cells.items():
            sums[c[d]] += t
        goal = {k: (v / total) ** mixing.TEMPER for k, v in sums.items()}
        goals.append({k: v / sum(goal.values()) for k, v in goal.items()})
    for _ in range(rounds):
        for d in range(3):
            sums = defaultdict(float)
            for c, t in w.items():
                sums[c[d]] += t
            w = {c: t * goals[d][c[d]] * total / sums[c[d]] if sums[c[d]] else 0 for c, t in w.items()}
    return {c: w[c] / t if t else 1.0 for c, t in cells.items()}, goals


def test_op8_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = by_id(mixing.mix_sources(docs))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {i: r.n_tokens for i, r in out.items()} == {i: len(words(t)) for i, t in text.items()}
    cells = defaultdict(int)
    for r in out.values():
        cells[r.source, r.lang, r.topic] += r.n_tokens
    ratio, _ = brute_rake(cells, 200)
    total = sum(cells.values())
    for r in out.values():
        assert r.weight == pytest.approx(ratio[r.source, r.lang, r.topic], rel=1e-3)
    expected = sum(r.n_tokens * r.probability for r in out.values())
    assert expected == pytest.approx(mixing.KEEP * total, rel=1e-9)
    assert all(r.selected for r in out.values() if r.probability == 1)


def test_op8_marginals_after_many_rounds(spark):
    out = mixing.op8_mix_sources(spark, SF01).collect()
    cells = defaultdict(int)
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    _, goals = brute_rake(cells)
    raked = defaultdict(float)
    for r in out:
        raked[r.topic] += r.weight * r.n_tokens
    assert {k: v / sum(raked.values()) for k, v in raked.items()} == pytest.approx(goals[2], rel=1e-3)


def test_op8_odd_rows(spark):
    n = len(ODD)
    docs = documents(spark, ODD, langs=[None, "en"] * (n // 2), sources=["a", None, "b"] * (n // 3)).selectExpr("*", "1 AS weight", "'q' AS topic")
    assert set(by_id(mixing.mix_sources(docs))) == set(range(n))
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert mixing.mix_sources(docs.where("doc_id < 2")).where("selected").count() == 2
    assert mixing.mix_sources(docs, topics="topic", targets={"topic": {"q": 1.0}}).count() == n


def test_op8_constant(spark):
    """The constant against a search over all cells, also where not all can be kept."""
    rng = np.random.default_rng(4)
    for tokens, weight in ((rng.integers(1, 1000, 60), rng.random(60) * 3), (rng.integers(1, 50, 5), np.array([0.0, 0.0, 0.0, 0.5, 2.0])), (np.array([0, 7]), np.array([1.0, 0.3]))):
        found = spark.createDataFrame(list(zip(map(int, tokens), map(float, weight), strict=True)), "tokens long, weight double")
        k = mixing.constant(found)
        kept = lambda k: (tokens * np.minimum(1, k * weight)).sum()
        most = kept(1e15)
        assert kept(k) == pytest.approx(min(most, mixing.KEEP * tokens.sum()), rel=1e-9)
    assert mixing.constant(found.where("false")) == 1.0


def shards_hold(out, texts, n):
    assert {i: (r.size, r.text_crc32) for i, r in out.items()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in out.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n))
    return slots


def test_op10_near_equal(spark):
    out = by_id(kd_shards.op10_kd_shards(spark, SF01))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(shards_hold(out, texts, 16)) == 16
    sizes = defaultdict(int)
    for r in out.values():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 2 * max(r.size for r in out.values())


def test_op10_splits_along_the_widest_dimension_at_the_median(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pts = kd_shards.written(kd_shards.points(docs))
    rows = kd_shards.tree(pts, 2).collect()
    dims = [f"c{i}" for i in range(4)]
    wide = max(dims, key=lambda d: max(r[d] for r in rows) - min(r[d] for r in rows))
    left, right = [r for r in rows if r.shard == 0], [r for r in rows if r.shard == 1]
    assert max(r[wide] for r in left) < min(r[wide] for r in right)
    total = sum(r.size for r in rows)
    best = min(abs(2 * s - total) for s in np.cumsum([r.size for r in sorted(rows, key=lambda r: r[wide])]))
    assert abs(2 * sum(r.size for r in left) - total) <= max(best, 2 * kd_shards.NEAR * total)


def brute_tree(rows, leaves, first=0):
    """Shard by place in rows of (size, c0..c3): widest dimension, median of bytes, as the docstring says."""
    if leaves == 1 or not rows:
        return {id(r): first for r in rows}
    dim = max(range(4), key=lambda i: (max(r[1 + i] for r in rows) - min(r[1 + i] for r in rows), -i))
    rows = sorted(rows, key=lambda r: r[1 + dim])
    want, below, k = sum(r[0] for r in rows) * (leaves // 2) / leaves, 0, 0
    while k < len(rows) - 1 and below + rows[k][0] < want:
        below += rows[k][0]
        k += 1
    k += abs(below + rows[k][0] - want) < abs(below - want)
    return brute_tree(rows[:k], leaves // 2, first) | brute_tree(rows[k:], leaves - leaves // 2, first + leaves // 2)


@pytest.mark.parametrize("leaves", [16, 5])
def test_op10_equals_brute_force(spark, leaves):
    pts = kd_shards.written(kd_shards.points(spark.read.parquet(f"{SF}/documents.parquet")))
    found = kd_shards.tree(pts, leaves).collect()
    rows = [(r.size, r.c0, r.c1, r.c2, r.c3) for r in found]
    shard = brute_tree(rows, leaves)
    assert [r.shard for r in found] == [shard[id(r)] for r in rows]


@pytest.mark.parametrize("smallest", [1, 2, 3, 48, 74, 299])
def test_op10_coordinates_stay_in_range(spark, smallest):
    docs = documents(spark, ["x" * (smallest - 1 + 7 * i) for i in range(12)], ids=[None, -(2**62), 2**62, *range(9)])
    for r in kd_shards.points(docs).collect():
        assert all(0 <= r[f"c{i}"] < kd_shards.END for i in range(4))
    spread = {r.c0 >> 32 for r in kd_shards.points(documents(spark, ["x"] * 6, ids=[None, 10, 20, 30, 40, 50])).collect()}
    assert len(spread) == 5  # the null id stretches no range


def test_op10_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 AS shard", "'x' AS salt", "'y' AS node")
    shards_hold(by_id(kd_shards.kd_shards(docs, 16)), dict(enumerate(ODD)), 16)
    shards_hold(by_id(kd_shards.kd_shards(docs, target_bytes=20000)), dict(enumerate(ODD)), 40)
    assert kd_shards.kd_shards(docs.where("false"), 16).count() == 0
    same = documents(spark, ["x"] * 50, ids=[None] * 25 + [3] * 25)
    out = kd_shards.kd_shards(same, 4).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == 50 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9_held_out_accuracy(spark):
    out = by_id(toxicity.op9_toxicity(spark, SF1))
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    assert {i: r.held_out for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in out}
    own = [(out[i].score, out[i].predicted, y) for i, y in truth.items() if out[i].held_out]
    hit = sum(p for _, p, y in own if y)
    assert hit >= 0.5 * sum(y for *_, y in own)
    assert hit >= 0.6 * sum(p for _, p, _ in own)
    assert all((s >= 0.3) == bool(p) and 0 <= s <= 1 for s, p, _ in own)


def test_op9_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 AS toxic", "0.5 AS score")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(ODD))] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for usable in (labels, labels.where("false"), labels.where("toxic = 1")):
        out = by_id(toxicity.score(docs, toxicity.fit(docs, usable)))
        assert set(out) == set(range(len(ODD))) and all(0 <= r.score <= 1 for r in out.values())
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, labels)).count() == 0


def test_op9_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BYTES", {0: 100, 1: 25})
    rows = spark.createDataFrame([(i, "x" * 10, "en", i % 2) for i in range(40)], "doc_id long, text string, lang string, toxic int")
    out = toxicity.within_bytes(rows).collect()
    assert sum(r.toxic == 0 for r in out) == 10 and sum(r.toxic == 1 for r in out) == 2


def test_op9_thresholds_are_best_by_language():
    rng = np.random.default_rng(8)
    langs, y = ["a"] * 60 + ["b"] * 60 + ["c"] * 5, rng.integers(0, 2, 125).astype(np.float32)
    scores = np.clip(y * 0.3 + rng.random(125) * 0.5 + np.array([0.2] * 60 + [0.0] * 65), 0, 1)
    found = toxicity.thresholds(langs, y, scores)
    assert set(found) == {"", "a", "b"}  # too few rows of c

    def f1(own, at):
        hit = (scores[own] >= at) & (y[own] == 1)
        return 2 * hit.sum() / ((scores[own] >= at).sum() + y[own].sum())

    for lang, own in (("a", np.arange(60)), ("b", np.arange(60, 120)), ("", np.arange(125))):
        assert f1(own, found[lang]) == pytest.approx(max(f1(own, x) for x in scores[own]))


def test_gradient_is_right():
    net = toxicity.Net(1)
    net.p = {k: v.astype(np.float64) + 0.05 * (k[0] == "b") for k, v in net.p.items()}
    x, places, lead = toxicity.layout(np.array([5, 6, 7, 8, 9, 6], np.int32), np.array([0, 4, 4, 6]))
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: np.mean(np.logaddexp(0, (z := net.logits(x, places, lead))) - y * z)
    g, touched, values = net.gradient(x, places, lead, y)
    g["e"] = np.zeros_like(net.p["e"])
    g["e"][touched] = values
    for name, at in (("e", (6, 2)), ("w2", (1, 3, 4)), ("b3", (2,)), ("o", (7,)), ("c", (0,))):
        old, step = net.p[name][at], 1e-6
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], abs=1e-6)
