"""The index on disk: a search reads the buckets of its words, and scores as a scan does."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import retrieval as ret
from quire.plans.spec import Term
from quire.sources import index, scratch


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("content"))


@pytest.fixture(scope="module")
def written(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.write(docs, ["content"], path)
    return index.read(spark, path)


def buckets_read(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numPartitions").value()


def test_words_are_read_from_their_buckets(written):
    rows = written["raw"].of(["the", "with"])
    assert 1 <= buckets_read(rows) <= 2 < buckets_read(written["raw"].rows)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", rows._jdf.queryExecution().toString())


def test_scores_equal_a_scan(written, docs):
    words = ["the", "with"]
    got = {r.doc_id: r.score for r in ret.bm25(written["raw"], words).collect()}
    want = {r.doc_id: r.score for r in ret.bm25_scan(docs, words).collect()}
    assert got == pytest.approx(want) and got


def test_written_and_unwritten_agree(written, docs):
    made = index.unwritten(docs, ["content"])
    for term in (Term("of the", "phrase"), Term("there", "fuzzy"), Term("with", "stem")):
        rows = lambda i: {(r.doc_id, r.field): r.score for r in ret.term_matches(i, term).collect()}  # noqa: B023, E731
        assert rows(written) == pytest.approx(rows(made))


def test_scratch_folders_go_when_told(spark, docs):
    import os

    made = scratch.written(docs.limit(3))
    folder = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert made.count() == 3 and os.path.isdir(folder)
    scratch.clear(spark)
    assert not os.path.exists(folder)
