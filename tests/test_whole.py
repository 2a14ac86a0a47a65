"""Queries that take every row of their tables."""

from quire.queries import ORACLES, QUERIES

from .oracle import compare, connection

SF = "/root/testdata/sf0.01"


def ids(spark, table, key):
    return {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}


def whole(spark, name):
    out = QUERIES[name](spark, SF)
    assert compare(out, connection(SF), ORACLES[name]) is None
    return out.collect()


def test_winners_among_all_suppliers(spark):
    out = whole(spark, "shared_neighbour_winner")
    assert out and all(r.mention_id % 20 == 0 for r in out)
    assert {r.mention_id for r in out} <= ids(spark, "supplier", "s_suppkey")


def test_slices_of_all_documents(spark):
    assert max(r.doc_id for r in whole(spark, "page_slice")) >= 100


def test_every_twentieth_vector_meets_all(spark):
    vectors = ids(spark, "embeddings", "vec_id")
    assert {(r.qid, r.vec_id) for r in whole(spark, "cosine_pairs")} == {(q, v) for q in vectors if q % 20 == 0 for v in vectors}
