import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from quire.llm import byte_bpe

from .helpers import ODD, by_id, documents, words
from .test_dedup import brute_words
from .test_near_copies import brute_firsts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(byte_bpe.RANKS)


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(text, enc):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_op6_equals_tiktoken(spark):
    enc = reference()
    out = by_id(byte_bpe.op6_byte_bpe(spark, SF))
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in out.items()} == {i: digests(t, enc) for i, t in rows.items()}


def test_units_and_white_space():
    random.seed(2)
    enc, codec = reference(), byte_bpe.Codec.of(PATH)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "!", "--", "\xa0", "　", "\x1c", "日本", "😀", "\r\n", " the", "\x85", "aaaa", "_"]
    texts = ["".join(random.choices(pieces, k=random.randrange(20))) for _ in range(4000)]
    for text, (n, ids, raw) in zip(texts, codec.digest(texts), strict=True):
        want = enc.encode_ordinary(text)
        assert (n, ids, raw) == (len(want), ",".join(map(str, want)).encode(), text.encode()), repr(text)


def test_op6_odd_rows_and_offsets(spark):
    enc = reference()
    docs = documents(spark, [*ODD, "😀日本 é"]).selectExpr("*", "1 AS ids", "'x' AS doc")
    out = by_id(byte_bpe.round_trip(docs, PATH))
    texts = dict(enumerate([*ODD, "😀日本 é"]))
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in out.items()} == {i: digests(t, enc) for i, t in texts.items()}
    encoded = byte_bpe.encode(docs, PATH)
    back = by_id(byte_bpe.decode(encoded, PATH))
    assert {i: r.decoded for i, r in back.items()} == {i: t or "" for i, t in texts.items()}
    r = back[len(ODD)]
    assert len(r.starts) == len(r.ids) and list(r.starts) == sorted(r.starts) and max(r.starts) < 6
    cut = spark.createDataFrame([(1, list(r.ids[:1]))], "doc_id long, ids array<int>")
    assert byte_bpe.decode(cut, PATH).first().raw == enc.decode_bytes([r.ids[0]])
    assert byte_bpe.round_trip(docs.where("false"), PATH).count() == 0


def test_pipeline_stage_by_stage(spark):
    enc = reference()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    (_, quality), (_, near), (_, substring), (_, mix), (_, bpe) = corpus_pipeline.STAGES
    one = corpus_pipeline.written(quality(spark, docs, SF))
    judged = by_id(corpus_pipeline.quality_rules.op2_quality_rules(spark, SF))
    assert one.columns == names and {r.doc_id for r in one.collect()} == {i for i, r in judged.items() if r.kept}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = corpus_pipeline.written(near(spark, one, SF))
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == brute_firsts(rows)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = corpus_pipeline.written(substring(spark, two, SF))
    want = {i: x for i, x in brute_words(rows).items() if x[1] < x[0] or not x[0]}
    got = {r.doc_id: hashlib.sha256(b" ".join(words(r.text))).hexdigest() for r in three.collect()}
    assert three.columns == names and got == {i: x[2] for i, x in want.items()}
    four = corpus_pipeline.written(mix(spark, three, SF))
    decided = by_id(corpus_pipeline.mixing.mix_sources(three))
    assert four.columns == names and {r.doc_id for r in four.collect()} == {i for i, r in decided.items() if r.selected}
    text = {r.doc_id: r.text for r in four.collect()}
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe(spark, four, SF).collect()}
    assert out == {i: digests(t, enc) for i, t in text.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == out


def test_pipeline_odd_rows(spark):
    texts = [*ODD, *ODD, " ".join(f"v{i % 97}x{i}" for i in range(400))]
    docs = documents(spark, texts, ids=[None, *range(len(texts) - 2), 3]).selectExpr("*", "'x' AS kept", "1 AS component")
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.written(stage(spark, rows, SF))
            assert rows.columns == docs.columns
        assert Counter(rows.columns)["doc_id"] == 1
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
