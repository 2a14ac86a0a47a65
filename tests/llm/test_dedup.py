import hashlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import common, simhash, suffixes
from quire.llm.substring_dedup import op1_substring_dedup, substring_dedup
from quire.llm.suffix_array_dedup import op4_suffix_array_dedup, suffix_array_dedup

from .helpers import ODD, PASSAGE, by_id, documents, words

SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, size=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            if k in seen:
                gone[a : a + size] = [True] * size
            seen.add(k)
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def brute_bytes(rows, size=200):
    b = {i: (t or "").encode() for i, t in rows}
    c = Counter(x[a : a + size] for x in b.values() for a in range(len(x) - size + 1))
    out = {}
    for i, x in b.items():
        gone = bytearray(len(x))
        for a in range(len(x) - size + 1):
            if c[x[a : a + size]] > 1:
                gone[a : a + size] = b"\1" * size
        kept = bytes(y for y, g in zip(x, gone) if not g)
        out[i] = (len(x), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), sha(kept))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op1_equals_brute_force(spark, rows):
    got = {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(op1_substring_dedup(spark, SF)).items()}
    assert got == brute_words(rows)
    assert sum(x[1] for x in got.values()) > 0


def test_op4_equals_brute_force(spark, rows):
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(op4_suffix_array_dedup(spark, SF)).items()}
    assert got == brute_bytes(rows)


def test_op1_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "'x' AS doc", "1 AS part", "'y' AS kept")
    got = {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring_dedup(docs)).items()}
    assert got == brute_words(list(enumerate(ODD)))


def test_op4_odd_rows(spark):
    texts = [t[:4000] if t else t for t in ODD]
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_array_dedup(documents(spark, texts))).items()}
    assert got == brute_bytes(list(enumerate(texts)))


@pytest.mark.parametrize(("crowd", "rows"), [(10, 50), (3, 7), (1, 2)])
def test_hot_prefixes_lengthen(spark, monkeypatch, crowd, rows):
    from quire.llm import substring_dedup as one
    from quire.llm import suffix_array_dedup as four
    from quire.llm.repeats import Windows

    texts = [f"left{i} " + PASSAGE + f" right{i} more{i}" for i in range(40)] + ["t" * 250, "u" * 250 + "t" * 210]
    monkeypatch.setattr(one, "windows", lambda size=20: Windows("word", size, 6, True, hot=5, crowd=crowd, rows=rows, texts=20))
    monkeypatch.setattr(four, "windows", lambda size=200: Windows("byte", size, 24, False, hot=5, crowd=crowd, rows=rows, texts=20))
    texts += [f"far{i} " + PASSAGE + f" away{i}" for i in range(9)] * 2 + [" ".join(["long" * 30, f"x{i % 4}", *["é" * 40 + str(k) for k in range(25)]]) for i in range(12)]
    docs = documents(spark, texts).repartition(3)
    got = {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring_dedup(docs)).items()}
    assert got == brute_words(list(enumerate(texts)))
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_array_dedup(docs, 50)).items()}
    assert got == brute_bytes(list(enumerate(texts)), 50)


def test_shared_and_null_ids(spark):
    docs = documents(spark, [PASSAGE, "other " + PASSAGE, PASSAGE, PASSAGE], ids=[None, 5, 5, 5])
    got = [(r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()]
    # The null id comes first; the repeated row of id 5 is one document, shown twice.
    assert sorted(got, key=str) == sorted([(None, 0), (5, 30), (5, 30), (5, 30)], key=str)


def test_many_rows_without_id_and_of_one_id(spark):
    texts = [f"a{i} {PASSAGE} z{i}" for i in range(40)]
    docs = documents(spark, [*texts, *texts[:10], "", "", None], ids=[None] * 20 + [7] * 20 + [None] * 5 + [7] * 5 + [None, 7, None])
    own = common.keyed(docs).collect()
    assert sorted(r.copies for r in own) == [1] * 41 + [2] * 6 and all(r.part == 0 or r.doc == 7 for r in own)
    gone = brute_words([((r.doc, r.part), r.text) for r in own])
    want = Counter()
    for r in own:
        want[7 if r.doc == 7 else None, *gone[r.doc, r.part]] += r.copies
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()) == want


def test_empty_tables(spark):
    none = documents(spark, ["x"]).where("false")
    assert substring_dedup(none).count() == 0
    assert suffix_array_dedup(none).count() == 0
    assert simhash.simhash_near_dups(none).count() == 0


@pytest.mark.parametrize("depth", [1, 5, 7, 20, 33])
def test_suffix_array_and_common_prefixes(depth):
    rng = np.random.default_rng(depth)
    for bits, most in ((8, 3), (32, 2), (8, 256)):
        sym = rng.integers(0, most, 400).astype(np.int64)
        sym[200:300] = sym[50:150]
        places = rng.permutation(len(sym) - depth + 1)[:300]
        found = suffixes.Suffixes(sym, bits, places, depth)
        own = [tuple(sym[p : p + depth]) for p in places]
        want = sorted(range(len(places)), key=lambda k: own[k])
        assert found.order.tolist() == want
        shared = [0] + [next((k for k in range(depth) if own[a][k] != own[b][k]), depth) for a, b in zip(want[:-1], want[1:])]
        assert found.lcp.tolist() == shared
        for d in (1, max(1, depth // 2), depth):
            groups = {}
            for k, place in enumerate(want):
                groups.setdefault(own[place][:d], []).append(k)
            nodes = [(g[0], g[-1] + 1) for g in groups.values() if len(g) > 1]
            first, end, parent = suffixes.deep_nodes(found.lcp, d)
            assert list(zip(first.tolist(), end.tolist())) == nodes
            around = [*shared, 0]
            assert parent.tolist() == [max(around[a], around[b]) for a, b in nodes] and all(x < d for x in parent)


def test_words_rank_as_their_bytes():
    import pyarrow as pa

    from quire.llm.common import flat

    texts = ["b a\tc a", "", "  ", "é a zz\n", "a"]
    rank, at = suffixes.word_symbols(*flat(pa.array(texts, pa.string())))
    own = [w for t in texts for w in t.encode().split()]
    assert rank.tolist() == [sorted(set(own)).index(w) for w in own] and at.tolist() == [0, 4, 4, 4, 7, 8]


def test_slices_keep_groups_and_share_first_rows():
    import pyarrow as pa

    from quire.llm import repeats

    schema = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("v", pa.int64())])
    rng = np.random.default_rng(2)
    for most in (2, 3, 10, 1000):
        g = np.sort(rng.integers(0, 12, 300) ** 2)
        k = np.concatenate([np.sort(rng.integers(0, 3, (g == x).sum())) for x in np.unique(g)])
        t = pa.table([pa.array(g), pa.array(k), pa.array(np.arange(300))], schema=schema)
        seen = set()
        for part, open_ in repeats.slices(t.to_batches(max_chunksize=7), schema, "g", "k", most):
            rows = part.to_pylist()
            assert len(rows) <= most and (not open_ or len({r["g"] for r in rows}) == 1)
            for x in {r["g"] for r in rows}:
                assert open_ == ((g == x).sum() > most)
            if open_:  # a later row of a kind comes with an earlier one
                for r in rows:
                    assert r["v"] not in seen or rows[0]["v"] == r["v"]
                for x in {r["k"] for r in rows}:
                    assert not any(r["k"] == x and r["v"] not in seen and any(k[y] == x and g[y] == r["g"] for y in seen) for r in rows) or any(r["k"] == x and r["v"] in seen for r in rows)
            seen |= {r["v"] for r in rows}
        assert seen == set(range(300))


def brute_simhash(rows, width=3, bits=2):
    import xxhash

    fp = {}
    for i, t in rows:
        w = (t or "").encode().translate(simhash.LOWER).split()
        s = [b" ".join(w[a : a + width]) for a in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_op7_equals_brute_force(spark, rows):
    got = {i: (r.fingerprint, r.component_id) for i, r in by_id(simhash.op7_simhash(spark, SF)).items()}
    assert got == brute_simhash(rows)
    assert any(i != c for i, (_, c) in got.items())


def test_op7_odd_rows(spark):
    got = {i: (r.fingerprint, r.component_id) for i, r in by_id(simhash.simhash_near_dups(documents(spark, ODD))).items()}
    assert got == brute_simhash(list(enumerate(ODD)))


@pytest.mark.parametrize("large", [1, 1024])
def test_links_within_two_bits(spark, large):
    import random

    random.seed(3)
    base = [random.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) for b in base for _ in range(6)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    vertices = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, lead long")
    got = {r.a.lead: r.b.lead for r in simhash.components(simhash.links(vertices, 2, large)).collect()}
    root = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(root))
