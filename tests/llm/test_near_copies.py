import numpy as np
import pyarrow as pa
import pytest

from quire.llm import near_copies as near
from quire.llm import simhash

from .helpers import ODD, documents

SF = "/root/testdata/sf0.001"


def shingle_set(text, width=near.WIDTH):
    w = (text or "").encode().translate(simhash.LOWER).split()
    return {tuple(w[a : a + width]) for a in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_firsts(rows):
    """The least id of each component of texts alike in 0.8 of their shingles."""
    rows = sorted(rows)
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= near.SIMILARITY:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted(r.doc_id for r in near.stage(spark, docs, SF).collect())
    assert kept == brute_firsts([(r.doc_id, r.text) for r in docs.collect()]) and len(kept) < docs.count()


def edited(rng, words, n):
    """words with n of them changed, each five apart at least."""
    out = list(words)
    for k in rng.choice(len(out) // 5, n, replace=False):
        out[5 * k] = f"new{rng.integers(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize(("few", "large"), [(64, 5000), (2, 5000), (64, 3)])
def test_copies_around_the_bar(spark, monkeypatch, few, large):
    """Families of copies with few and with many edits: similar ones go, dissimilar ones stay, chains hold together."""
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "LARGE", large)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        texts += [" ".join(base), *(edited(rng, base, n) for n in (1, 3, 6, 8, 12, 20, 40)), " ".join(base).upper(), " ".join(base)]
    docs = documents(spark, texts).repartition(3)
    assert sorted(r.doc_id for r in near.stage(spark, docs, "").collect()) == brute_firsts(list(enumerate(texts)))


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, *ODD]).selectExpr("*", "1 AS prints", "'x' AS keys", "2 AS th")
    out = near.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute_firsts(list(enumerate([*ODD, *ODD])))
    assert near.stage(spark, docs.where("false"), "").count() == 0
    same = documents(spark, ["a b c"] * 4 + ["d"], ids=[None, None, 3, 2, None])
    assert sorted((r.doc_id is None, r.text) for r in near.stage(spark, same, "").collect()) == [(True, "a b c"), (True, "d")]


@pytest.mark.parametrize(("piece", "few"), [(3, 0), (10**6, 0), (50, 64), (10**6, 64)])
def test_trie_join_finds_all_components(piece, few):
    rng = np.random.default_rng(piece)
    base = rng.integers(0, 2**63, (12, 2), dtype=np.uint64)
    prints = np.repeat(base, 6, axis=0)
    for p in prints:
        for _ in range(rng.integers(0, 9)):
            p[rng.integers(2)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    prints = np.concatenate((prints, prints[:3], prints[:3]))
    group = rng.integers(0, 3, len(prints))
    order = np.lexsort((prints[:, 1], prints[:, 0], group))
    prints, group = prints[order], group[order]
    a, b = simhash.trie_join(prints, group, 7, few, piece)
    close = [(x, y) for x in range(len(prints)) for y in range(x) if group[x] == group[y] and sum(int(v).bit_count() for v in prints[x] ^ prints[y]) <= 7]
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} <= set(close)
    roots = []
    for pairs in (close, list(zip(a.tolist(), b.tolist()))):
        root = list(range(len(prints)))
        for x, y in pairs * 40:
            root[x] = root[y] = min(root[x], root[y])
        roots.append(root)
    assert roots[0] == roots[1]
    if few:
        assert len(a) == len(close)
    else:
        assert len(a) == len(prints) - len(set(roots[0]))  # a forest: no pair too many


def test_similarity():
    texts = ["a b c d e f", "a b c d e g", "", None, "x", "X", "a b c d e f g h"]
    pairs = [(x, y) for x in texts for y in texts]
    got = near.similarity(pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string()))
    assert got.tolist() == pytest.approx([jaccard(shingle_set(x), shingle_set(y)) for x, y in pairs])
