"""Pipeline stages over rows without doc_id, and over different texts of one doc_id."""

import random
from collections import Counter

from quire.llm import mixing, near_copies, quality_rules, substring_dedup

from .helpers import documents


def prose(seed, n=120):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(5000)}" for _ in range(n))


def test_stages_tell_texts_apart(spark):
    texts = [prose(i, 120 + i % 7) for i in range(70)]
    ids = [None] * 60 + [5] * 10
    found = lambda stage, docs: Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect())
    every = Counter(zip(ids, texts, strict=True))

    # Rejected rows take no others of their id.
    docs = documents(spark, [*texts, "too short", "also short"], ids=[*ids, None, 5])
    assert found(quality_rules.stage, docs) == every

    # Copies of a text go, whether they have the same id or another; other texts stay.
    docs = documents(spark, [*texts, texts[0], texts[1], texts[65], texts[3]], ids=[*ids, None, 9, 5, 5])
    assert found(near_copies.stage, docs) == every

    # A row that loses its repeat gives its text to no other; a row of which nothing is left goes alone.
    docs = documents(spark, [*texts, texts[0] + " more", texts[1], texts[2] + " tail"], ids=[*ids, 5, 5, 6])
    assert found(substring_dedup.stage, docs) == every + Counter([(5, "more"), (6, "tail")])

    # Rows without an id are sampled one by one.
    docs = documents(spark, texts[:60], ids=[None] * 60)
    assert 35 < sum(found(mixing.stage, docs).values()) < 60
