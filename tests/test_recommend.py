import datetime as dt

from quire.operators import recommend as rec
from quire.operators.aggregates import affinity, rebuilt

T0 = dt.datetime(2024, 1, 1)


def frames(spark):
    docs = spark.createDataFrame([(i, T0 + dt.timedelta(days=i)) for i in range(1, 7)], "doc_id long, uploaded_at timestamp")
    authors = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "doc_id long, author_id long")
    cats = spark.createDataFrame([(4, 9)], "doc_id long, category_id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (5, [0.0, 1.0])], "doc_id long, embedding array<double>")
    return docs, authors, cats, vectors


def test_tiers(spark):
    docs, authors, cats, vectors = frames(spark)
    aff = spark.createDataFrame([(1, 1, 5.0), (2, 3, 2.0), (2, 4, 1.0)], "user_id long, doc_id long, engagement_score double")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    out = rec.recommend(users, aff, docs, vectors, authors, cats, 3).collect()
    mine = lambda u: [(r.doc_id, r.reason) for r in sorted(out, key=lambda r: r["rank"]) if r.user_id == u]
    assert mine(1) == [(2, "more_by_author"), (5, "for_you")]
    assert mine(3) == [(1, "popular"), (3, "popular"), (4, "popular")]
    # Nothing shares a facet with what user 2 read, and no vector either: the popular rest.
    assert mine(2) == [(1, "popular")]


def test_newest_when_nobody_reads(spark):
    docs, authors, cats, vectors = frames(spark)
    none = spark.createDataFrame([(1, 1, 0.0)], "user_id long, doc_id long, engagement_score double").where("false")
    out = rec.recommend(spark.createDataFrame([(1,)], "user_id long"), none, docs, vectors, authors, cats, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.reason) for r in out] == [(6, "newest"), (5, "newest")]


def test_floored_bookmarks_and_rebuild(spark):
    schema = "user_id long, doc_id long, event_type string, ts timestamp, event_id long, read_ms long, pages_read long, percent double"
    kinds = ["bookmark_remove", "bookmark_add", "bookmark_remove", "bookmark_remove", "bookmark_add"]
    rows = [(1, 1, k, T0 + dt.timedelta(minutes=i), i, None, None, None) for i, k in enumerate(kinds)] + [(1, None, "search", T0, 99, None, None, None)]
    got = affinity(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].bookmark_count == 1
    a = spark.createDataFrame([(1, 1, 2, T0)], "user_id long, doc_id long, note_count long, ts timestamp")
    b = spark.createDataFrame([(1, 1, 0.5, T0 + dt.timedelta(days=1))], "user_id long, doc_id long, percent_complete double, ts timestamp")
    r = rebuilt([a, b]).first()
    assert (r.note_count, r.percent_complete, r.first_engaged_at) == (2, 0.5, T0)


def test_affinities_are_made_once(spark):
    """All tiers read the written fold of the events, so it is not made again for each."""
    docs, authors, cats, vectors = frames(spark)
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    aff = spark.createDataFrame([(1, 1, 5.0), (2, 3, 2.0), (2, 4, 1.0)], "user_id long, doc_id long, engagement_score double")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    rec.recommend(users, aff.mapInArrow(counted, aff.schema), docs, vectors, authors, cats, 3).collect()
    assert rows.value == 3
