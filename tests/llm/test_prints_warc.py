import hashlib

import numpy as np

from quire.llm import fingerprints as f
from quire.llm import warc

from .helpers import ODD, by_id, documents

SF = "/root/testdata/sf0.001"


def expected(rows):
    out = {}
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt)
    return out


def chunks_of(data):
    """Chunking byte by byte, as the rule says it."""
    out, start = [], 0
    while start < len(data):
        end = len(data)
        for at in range(start, min(len(data), start + f.MOST)):
            n = at - start + 1
            if n < f.LEAST:
                continue
            h = sum(int(f.GEAR[data[at - age]]) << age for age in range(min(32, at + 1))) & 0xFFFFFFFF
            if n < f.NORMAL and h & int(f.HARD) == 0 or n >= f.NORMAL and h & int(f.EASY) == 0 or n == f.MOST:
                end = at + 1
                break
        out.append(data[start:end])
        start = end
    return out


def like(a, b):
    a, b = set(chunks_of(a)), set(chunks_of(b))
    return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)


def check(out, rows):
    want = expected(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in out.items()} == {i: w[:2] for i, w in want.items()}
    for i, (_, _, t, e, nxt) in want.items():
        if len(t) < 6000:
            assert abs(out[i].near_edited - like(t.encode(), e.encode())) < 1e-9
            if len(nxt) < 6000:
                assert abs(out[i].near_next - like(t.encode(), nxt.encode())) < 1e-9


def test_op3_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = by_id(f.op3_cdc_fingerprints(spark, SF))
    check(out, rows)
    assert np.mean([r.near_edited for r in out.values()]) > 0.35
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t, out[i].fingerprint) == out[i].fingerprint


def test_op3_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "'x' AS doc", "3 AS fingerprint")
    check(by_id(f.compared(docs.repartition(5))), list(enumerate(ODD)))
    assert f.compared(docs.where("false")).count() == 0
    one = f.compared(docs.where("doc_id = 6")).first()
    assert one.near_next == 1.0
    same = documents(spark, ["a", "b", "c"], ids=[None, 4, 4])
    assert sorted((r.doc_id is None, r.n_chars) for r in f.compared(same).collect()) == [(False, 1), (False, 1), (True, 1)]
    assert {r.doc_id for r in f.fingerprint(docs).collect()} == set(range(len(ODD)))


def test_shift_keeps_most_chunks(spark):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 20000, dtype=np.uint8))
    prints = f.Prints([text, text[:9000] + b"inserted" + text[9000:]])
    assert prints.likeness(np.array([0]), np.array([1]))[0] > 0.95


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, size long")


def test_op5_round_trip(spark):
    long, other = "<p>" + "x" * 200, "<p>" + "é" * 300
    rows = [(3, "http://a/ b", long, 1), (1, None, long, 1), (2, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u", other, 1), (None, "u", other, 1), (8, "u", "y" * 300000, 1)]
    archives = warc.written(warc.bundles(warc.planned(pages(spark, rows).repartition(3))))
    got = {r.page: r for r in warc.read(archives).collect()}
    null = warc.NULL_ID
    assert {p: r.record_type for p, r in got.items()} == {3: "revisit", 1: "response", 2: "response", 4: "response", 5: "response", 6: "response", 7: "revisit", null: "response", 8: "response"}
    assert got[3].refers == 1 and got[7].refers == null
    for page, _, html, _ in rows:
        r = got[null if page is None else page]
        assert r.payload_digest == hashlib.sha256((html or "").encode()).hexdigest() and r.payload_bytes == len((html or "").encode())
        assert r.record_type == "revisit" or bytes(r.payload).decode() == (html or "")
    data = {r.bundle: bytes(r.data) for r in archives.collect()}
    for r in warc.index(archives).collect():
        head, _ = warc.lookup(data[r.bundle], r.frame, r.place)
        assert head["WARC-Record-ID"] == f"<urn:page:{r.page}>"


def test_op5_whole_table_and_files(spark, tmp_path):
    import zstandard

    out = by_id(warc.op5_warc(spark, SF), "page_id")
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {i: r.payload_digest for i, r in out.items()} == {i: hashlib.sha256(h.encode()).hexdigest() for i, h in html.items()}
    archives = warc.written(warc.bundles(warc.planned(spark.read.parquet(f"{SF}/pages.parquet"))))
    warc.export(archives, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.warc.zst"))
    with files[0].open("rb") as f:  # a plain decoder skips the seek table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1")
    assert warc.read(warc.bundles(warc.planned(spark.read.parquet(f"{SF}/pages.parquet").where("false")))).count() == 0
