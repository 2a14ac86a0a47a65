from collections import Counter

import numpy as np

from quire.llm import quality_rules as q

from .helpers import ODD, by_id, documents, words

SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
    hit = set()
    for a in range(len(w) - 2):
        if grams[tuple(w[a : a + 3])] > 1:
            hit |= {a, a + 1, a + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def got(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_statistics(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = by_id(q.op2_quality_rules(spark, SF))
    assert {i: got(r) for i, r in out.items()} == {i: base(t) for i, t in rows.items()}
    assert all(not r.kept for r in out.values() if r.base_failed)


def test_odd_rows(spark):
    texts = [*ODD, "a\nb\na\n\na", "a\nb\na", "\n\n", "x y\nx y\n", "#*$%&|<> é"]
    docs = documents(spark, texts, langs=[None] * len(texts)).selectExpr("*", "1 AS n_words", "'g' AS g", "2 AS doc")
    out = by_id(q.quality_rules(docs))
    assert {i: got(r) for i, r in out.items()} == {i: base(t) for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert q.quality_rules(documents(spark, ["x"]).where("false")).count() == 0


def brute_mcd(x):
    """The same estimate by numpy, with exact quantiles."""
    floors = np.square(q.FLOORS)
    m = np.median(x, axis=0)
    p = np.diag(1 / ((1.4826 * np.median(abs(x - m), axis=0)) ** 2 + floors))
    for _ in range(q.STEPS):
        d = np.einsum("ni,ij,nj->n", x - m, p, x - m)
        near = x[d <= np.sort(d)[int(np.ceil(q.SHARE * len(d))) - 1]]
        m, p = near.mean(axis=0), np.linalg.inv(np.cov(near.T, bias=True) / q.SHRUNK + np.diag(floors))
    return np.einsum("ni,ij,nj->n", x - m, p, x - m)


def test_distances_and_outliers(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4001, 5)) * [0.6, 0.3, 0.5, 0.05, 0.05] + [6, 5, 1, 0.1, 0.1]
    x[:400] += [0, 0, 6, 0.9, 0]
    rows = [(i, "en", *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "i long, g string, f0 double, f1 double, f2 double, f3 double, f4 double")
    found = q.estimates(frame.select("g", *q.FEATURES))
    d = {r.i: r.d for r in frame.join(found, "g").select("i", q._distance().alias("d")).collect()}
    want = brute_mcd(x)
    assert np.allclose([d[i] for i in range(len(x))], want, rtol=0.02, atol=0.05)
    assert min(want[:400]) > q.CUTOFF and np.mean(want[400:] > q.CUTOFF) < 0.001


def test_small_groups_are_judged_by_their_language_or_all(spark):
    rng = np.random.default_rng(11)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 100 + i)) for i in range(90)]
    odd = [" ".join(f"#$%&|<>{x}#$%&|<>" for x in rng.integers(0, 5000, 100 + i)) for i in range(6)]
    texts = [*plain, *odd, *plain[:3]]
    langs = ["en"] * 90 + ["en"] * 3 + ["xx", None, "en"] + ["en", "xx", None]
    sources = ["big"] * 90 + ["few", "few", "lone", "few", None, None] + ["few", "few", "few"]
    out = by_id(q.quality_rules(documents(spark, texts, langs=langs, sources=sources)))
    assert not any(r.base_failed for r in out.values())
    assert {i for i, r in out.items() if not r.kept} == set(range(90, 96))


def test_fallback_estimates_are_of_all_documents(spark):
    rng = np.random.default_rng(5)
    rows = [("en", "a")] * 70 + [("en", None)] * 65 + [("en", "b")] * 4 + [("de", "a")] * 3 + [(None, "a")] * 2
    x = rng.normal(size=(len(rows), 5)) * [0.6, 0.3, 0.5, 0.05, 0.05] + [6, 5, 1, 0.1, 0.1]
    x[:70] += [0, 3, 0, 0, 0]
    frame = spark.createDataFrame([(i, *k, False, *map(float, v)) for i, (k, v) in enumerate(zip(rows, x, strict=True))], "i long, lang string, source string, base_failed boolean, f0 double, f1 double, f2 double, f3 double, f4 double")
    stats = q.grouped(frame)
    found = q.estimates(stats.selectExpr("explode(feeds) AS g", *q.FEATURES))
    d = {r.i: r.d for r in stats.join(found, "g").select("i", q._distance().alias("d")).collect()}
    spans = {range(0, 70): x[:70], range(70, 135): x[70:135], range(135, 139): x[:139], range(139, 144): x}
    for span, own in spans.items():
        want = brute_mcd_of(own, x[span.start : span.stop])
        assert np.allclose([d[i] for i in span], want, rtol=0.02, atol=0.05)


def brute_mcd_of(x, points):
    """brute_mcd's distances of points by the estimate of x."""
    floors = np.square(q.FLOORS)
    # percentile_approx takes the lower of two middle values.
    m = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    p = np.diag(1 / ((1.4826 * np.sort(abs(x - m), axis=0)[(len(x) + 1) // 2 - 1]) ** 2 + floors))
    for _ in range(q.STEPS):
        d = np.einsum("ni,ij,nj->n", x - m, p, x - m)
        near = x[d <= np.sort(d)[int(np.ceil(q.SHARE * len(d))) - 1]]
        m, p = near.mean(axis=0), np.linalg.inv(np.cov(near.T, bias=True) / q.SHRUNK + np.diag(floors))
    return np.einsum("ni,ij,nj->n", points - m, p, points - m)
