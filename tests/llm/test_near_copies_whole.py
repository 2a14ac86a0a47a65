import numpy as np
import pyarrow as pa
import pytest

from quire.llm import near_copies as near

from .helpers import documents
from .test_near_copies import brute_firsts, edited


@pytest.mark.parametrize(("few", "large", "many"), [(64, 2000, 4), (1, 7, 0)])
def test_chains_at_the_bar(spark, monkeypatch, few, large, many):
    """Texts that are like another by little more than the bar, and by that only like the first; a passage that all of them
    have; short texts, where one word decides."""
    for name, value in (("FEW", few), ("LARGE", large), ("MANY", many)):
        monkeypatch.setattr(near, name, value)
    rng = np.random.default_rng(11)
    shared, texts = [f"s{x}" for x in range(30)], []
    for _ in range(60):
        chain = [[f"w{x}" for x in rng.integers(0, 10**6, 120)] + shared]
        for _ in range(3):
            chain.append(edited(rng, chain[-1], 3).split())
        texts += [" ".join(chain[k]) for k in rng.permutation(4)]
    for n in range(1, 40):
        base = [f"v{n}x{x}" for x in range(n)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(["less", *base[1:]])]
    docs = documents(spark, texts).repartition(3)
    assert sorted(r.doc_id for r in near.stage(spark, docs, "").collect()) == brute_firsts(list(enumerate(texts)))


def test_parities_never_differ_in_more_places_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    own = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 15, 16, 17, 60, 64, 70, 200, 250, 256, 257, 300)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in own])))
    bits, off = near.parities(np.concatenate(own), at)
    pairs = [(x, y) for x in range(len(own)) for y in range(len(own))]
    a, b = np.array(pairs).T
    apart = np.array([len(np.setxor1d(own[x], own[y])) for x, y in pairs])
    found = near.differing(bits, off, a, b)
    assert (found <= apart).all() and ((apart - found) % 2 == 0).all() and found[apart > 0].min() > 0


def test_packed_sets_come_back():
    h, at = near.shingles(*near.flat(pa.array(["a b c d e f", "", None, "x"])))
    back, off = near.unpacked(near.packed(h, at).slice(0))
    assert back.tolist() == h.tolist() and off.tolist() == at.tolist()
