"""Queries of list search, expansion, orders, filters and recommendations over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import extraction as ext
from ..operators import filters as fil
from ..operators import recommend as rec
from ..operators import retrieval as ret
from ..operators import windows as win
from ..plans.spec import Term, parsed_term, written_term
from ..sources.readers import table
from .tables import AFFINITY, EVENT, HYBRID, TOKENS, _library, affinities, cos, documents, event_rows, index, query, scored, six, six_sql, vec


@query(f"WITH {TOKENS}, {scored(['the', 'with'])} SELECT doc_id, {six_sql('score', 'score')} FROM s JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2', 'src3') ORDER BY s.score DESC, doc_id LIMIT 10")
def list_search(spark, d):
    docs = fil.by_values(documents(spark, d), "source", ["src1", "src2", "src3"])
    return ret.list_search(index(spark, d)["raw"], docs, ["the", "with"]).select("doc_id", six("score"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'of the')")
def list_search_fallback(spark, d):
    docs = documents(spark, d).withColumnRenamed("text", "content")
    return ret.list_search(index(spark, d)["raw"], docs, [], fallback="Of the").select("doc_id")


@query(f"""WITH {HYBRID}, r AS (SELECT doc_id, max(x) AS x FROM (SELECT doc_id, score AS x FROM s UNION ALL SELECT doc_id, sem FROM k) GROUP BY 1), g AS (SELECT doc_id FROM r ORDER BY x DESC, doc_id LIMIT 200), p AS (SELECT DISTINCT doc_id, token FROM t),
fg AS (SELECT token, count(*) AS fg FROM p JOIN g USING (doc_id) GROUP BY 1 HAVING count(*) >= 2), bg AS (SELECT token, count(*) AS bg FROM p GROUP BY 1),
x AS (SELECT token, fg, bg, fg / (SELECT count(*) FROM g)::DOUBLE AS f, bg / (SELECT n FROM st)::DOUBLE AS b FROM fg JOIN bg USING (token))
SELECT token, fg, bg, {six_sql('(f - b) * f / b', 'score')} FROM x WHERE (f - b) * f / b > 0 ORDER BY (f - b) * f / b DESC, token LIMIT 10""")
def keyword_expansion(spark, d):
    raw = index(spark, d)["raw"]
    lexical = ret.best_fields(ret.bm25(raw, ["the", "with"])).withColumnRenamed("score", "lexical_score")
    near = ret.knn(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), vec(spark, d), 100)
    return ret.expansion(raw, lexical, near).select("token", "fg", "bg", six("score"))


OF_THE = """a AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nt FROM t) WHERE token = 'of' AND nt = 'the')"""
NEAR = """v AS (SELECT DISTINCT token FROM t), f AS (SELECT doc_id FROM t JOIN v USING (token) WHERE levenshtein(token, 'with') <= 1 OR levenshtein(token, 'there') <= 1 GROUP BY doc_id
HAVING count(*) FILTER (levenshtein(token, 'with') <= 1) > 0 AND count(*) FILTER (levenshtein(token, 'there') <= 1) > 0)"""


@query(f"WITH {TOKENS}, {OF_THE}, {NEAR}, w AS (SELECT doc_id FROM t WHERE token IN ('with', 'there') GROUP BY doc_id HAVING count(DISTINCT token) = 2) SELECT 'phrase' AS kind, doc_id FROM a UNION ALL SELECT 'typed', doc_id FROM f UNION ALL SELECT 'folded', doc_id FROM (SELECT doc_id FROM f UNION SELECT doc_id FROM w)")
def legacy_matches(spark, d):
    one = lambda kind, text, *how: ret.legacy_matches(index(spark, d), text, *how).select(F.lit(kind).alias("kind"), "doc_id")
    return one("phrase", "of the", True, False).unionByName(one("typed", "with there", False, False)).unionByName(one("folded", "with there", False, True))


@query("""WITH h AS (SELECT p_partkey, regexp_replace(p_name, '(?i)(an)', '<mark>\\1</mark>', 'g') AS a, regexp_replace(p_type, '(?i)(an)', '<mark>\\1</mark>', 'g') AS b, contains(lower(p_name), 'an') AS ha, contains(lower(p_type), 'an') AS hb FROM part)
SELECT p_partkey, CASE WHEN ha THEN a WHEN hb THEN b END AS snippet, CASE WHEN ha THEN regexp_replace(a, '</?mark>', '', 'g') WHEN hb THEN regexp_replace(b, '</?mark>', '', 'g') END AS plain FROM h""")
def first_snippets(spark, d):
    from ..functions import text as T

    shown = lambda c: F.when(F.contains(F.lower(c), F.lit("an")), F.array(T.highlight(c, "an"))).otherwise(F.array().cast("array<string>"))
    t = table(spark, d, "part").withColumns({"a": shown("p_name"), "b": shown("p_type")})
    return t.select("p_partkey", ret.first_snippet(["a", "b"]).alias("snippet"), ret.first_snippet(["a", "b"], plain=True).alias("plain"))


# Orders show in what a limit leaves.


@query("SELECT o_orderkey, o_totalprice / 1e6::DOUBLE AS score FROM orders ORDER BY floor(o_totalprice / 1e6::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) DESC, o_orderdate DESC, o_orderkey LIMIT 200")
def rounded_score_order(spark, d):
    t = table(spark, d, "orders").withColumn("score", F.col("o_totalprice") / F.lit(1e6))
    return win.by_score(t, key="o_orderkey", newest="o_orderdate").limit(200).select("o_orderkey", "score")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_quantity DESC, l_linenumber, l_orderkey, l_partkey LIMIT 100")
def score_page_order(spark, d):
    t = table(spark, d, "lineitem").withColumn("page", F.struct("l_linenumber", "l_orderkey", "l_partkey"))
    return win.by_page(t, "l_quantity").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT 'down' AS way, c_custkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25) UNION ALL SELECT 'default', c_custkey FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 25)
UNION ALL SELECT 'up', c_custkey FROM (SELECT * FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 25)""")
def whitelisted_orders(spark, d):
    t = table(spark, d, "customer")
    one = lambda way, wanted: win.whitelisted_order(t, wanted, ["c_acctbal", "c_mktsegment"], "c_name", "c_custkey").limit(25).select(F.lit(way).alias("way"), "c_custkey")
    return one("down", "-c_acctbal").unionByName(one("default", "c_nationkey; DROP")).unionByName(one("up", "c_mktsegment"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))), ',') AS merged FROM lineitem GROUP BY 1")
def merged_arrays(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return t.select("l_orderkey", F.array_join(win.merged_terms("a", "b"), ",").alias("merged"))


@query("SELECT o_orderkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 20)")
def filter_centuries(spark, d):
    docs, bridge, _ = _library(spark, d)
    authors = table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_nationkey").alias("death_century"))
    return fil.by_dimension(docs, bridge, authors, F.col("death_century").isin(fil.centuries(["0", "3", "21", "x", "20"]))).select("doc_id")


@query(f"WITH {EVENT} SELECT event_id, 'all' AS scope FROM e WHERE user_id = 7 UNION ALL SELECT event_id, 'one' FROM e WHERE user_id = 7 AND doc_id = 29")
def rows_of_user(spark, d):
    e = event_rows(spark, d)
    return fil.of_user(e, 7).select("event_id", F.lit("all").alias("scope")).unionByName(fil.of_user(e, 7, 29).select("event_id", F.lit("one").alias("scope")))


@query("SELECT key, count(*) AS n FROM (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'person:id:' || s_nationkey ELSE 'person:' || lower(s_name) END AS key FROM supplier) GROUP BY 1")
def entity_group_keys(spark, d):
    t = table(spark, d, "supplier").select(F.lit("person").alias("entity_type"), F.lower("s_name").alias("normalized_text"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("linked_id"))
    return t.groupBy(ext.group_key().alias("key")).agg(F.count("*").alias("n"))


GRAMMAR = ["+p:of the", "~w:with", "-fd:mis", "+f1d:word", "+s:stem", "+sd:stem", "?w:x", "+w1:x", "+w: ", "plain", "+w:a%2Bb%20c"]


@query("""SELECT value, text, "match", op, fuzziness, diacritics, back FROM (VALUES ('+p:of the', 'of the', 'phrase', 'must', 'AUTO', 'ignore', '+p:of%20the'), ('~w:with', 'with', 'word', 'should', 'AUTO', 'ignore', '~w:with'), ('-fd:mis', 'mis', 'fuzzy', 'must_not', 'AUTO', 'sensitive', '-fd:mis'),
('+f1d:word', 'word', 'fuzzy', 'must', '1', 'sensitive', '+f1d:word'), ('+s:stem', 'stem', 'stem', 'must', 'AUTO', 'ignore', '+s:stem'), ('+sd:stem', NULL, NULL, NULL, NULL, NULL, NULL), ('?w:x', NULL, NULL, NULL, NULL, NULL, NULL), ('+w1:x', NULL, NULL, NULL, NULL, NULL, NULL),
('+w: ', NULL, NULL, NULL, NULL, NULL, NULL), ('plain', NULL, NULL, NULL, NULL, NULL, NULL), ('+w:a%2Bb%20c', 'a+b c', 'word', 'must', 'AUTO', 'ignore', '+w:a%2Bb%20c')) t(value, text, "match", op, fuzziness, diacritics, back)""")
def term_grammar(spark, d):
    terms = [(v, parsed_term(v)) for v in GRAMMAR]
    rows = [(v, t.text, t.match, t.op, str(t.fuzziness), t.diacritics, written_term(t)) if t else (v, *[None] * 6) for v, t in terms]
    return spark.createDataFrame(rows, "value string, text string, match string, op string, fuzziness string, diacritics string, back string")


@query(f"""WITH {AFFINITY}, n AS (SELECT user_id, doc_id, (doc_id % 5)::BIGINT AS note_count, min(ts) AS ts FROM e WHERE doc_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT user_id, doc_id, max(value / 100) AS percent_complete, max(ts) AS ts FROM e WHERE doc_id IS NOT NULL AND event_type = 'reading_session' GROUP BY 1, 2)
SELECT user_id, doc_id, coalesce(note_count, 0) AS note_count, coalesce(percent_complete, 0) AS percent_complete, least(n.ts, r.ts) AS first_engaged_at, greatest(n.ts, r.ts) AS last_engaged_at FROM n FULL JOIN r USING (user_id, doc_id)""")
def affinity_rebuilt(spark, d):
    e = event_rows(spark, d).where("doc_id IS NOT NULL")
    notes = e.groupBy("user_id", "doc_id").agg((F.first("doc_id") % 5).alias("note_count"), F.min("ts").alias("ts"))
    read = e.where("event_type = 'reading_session'").groupBy("user_id", "doc_id").agg(F.max("percent").alias("percent_complete"), F.max("ts").alias("ts"))
    return agg.rebuilt([notes, read]).select("user_id", "doc_id", "note_count", "percent_complete", "first_engaged_at", "last_engaged_at")


# Recommendations: every twentieth user, readers and others, against all documents.

USERS = "u AS (SELECT user_id FROM (SELECT user_id FROM events UNION SELECT c_custkey FROM customer) WHERE user_id % 20 = 0)"
LIKED = """fav AS (SELECT user_id, doc_id, w FROM (SELECT user_id, doc_id, greatest(engagement_score, 0) + 1 AS w, row_number() OVER (PARTITION BY user_id ORDER BY engagement_score DESC, doc_id) AS n FROM a JOIN u USING (user_id)) WHERE n <= 25),
wa AS (SELECT user_id, label, sum(w) AS wa FROM fav JOIN embeddings ON doc_id = vec_id GROUP BY 1, 2), wc AS (SELECT user_id, source, sum(w) AS wc FROM fav JOIN documents USING (doc_id) GROUP BY 1, 2)"""


def faceted(candidates: str) -> str:
    """fs: candidates (user_id, doc_id, sem) with their facet score and shared author."""
    return f"""fs AS (SELECT c.user_id, c.doc_id, sem, coalesce(wa, 0) + coalesce(wc, 0) AS raw, CASE WHEN wa IS NOT NULL THEN wa.label END::BIGINT AS best_author FROM {candidates} c LEFT JOIN embeddings v ON v.vec_id = c.doc_id LEFT JOIN wa ON wa.user_id = c.user_id AND wa.label = v.label
LEFT JOIN documents x ON x.doc_id = c.doc_id LEFT JOIN wc ON wc.user_id = c.user_id AND wc.source = x.source)"""


REASON = "CASE WHEN best_author IS NOT NULL THEN 'more_by_author' ELSE 'for_you' END AS reason"
POPULAR = """l AS (SELECT doc_id, sum(engagement_score) AS score FROM a GROUP BY 1), p AS (SELECT user_id, doc_id, score, 'popular' AS reason, NULL::BIGINT AS best_author FROM u, l WHERE user_id NOT IN (SELECT user_id FROM fav))"""


def ranked(every: str) -> str:
    return f"SELECT user_id, doc_id, {six_sql('score', 'score')}, reason, best_author, tier, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rank FROM ({every})) WHERE rank <= 12"


def recommended(spark, d, least_vector):
    a = affinities(spark, d)
    e = table(spark, d, "embeddings")
    users = table(spark, d, "events").select("user_id").union(table(spark, d, "customer").select("c_custkey")).distinct().where("user_id % 20 = 0")
    vectors = e.where(F.col("vec_id") >= least_vector).select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = documents(spark, d).select("doc_id", F.to_timestamp(F.lit("2024-01-01")).alias("uploaded_at"))
    authors = e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("author_id"))
    categories = documents(spark, d).select("doc_id", F.xxhash64("source").alias("category_id"))
    return rec.recommend(users, a, docs, vectors, authors, categories).select("user_id", "doc_id", six("score"), "reason", "best_author", "tier", "rank")


@query(f"""WITH {AFFINITY}, {USERS}, {LIKED}, m AS (SELECT user_id, i, sum(v * w) / sum(w) AS v FROM (SELECT user_id, w, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM fav JOIN embeddings ON vec_id = doc_id) GROUP BY 1, 2), c AS (SELECT user_id, list(v ORDER BY i) AS c FROM m GROUP BY 1),
near AS (SELECT * FROM (SELECT user_id, vec_id AS doc_id, (1 + x) / 2 AS sem, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, vec_id) AS n FROM (SELECT user_id, vec_id, {cos('c', 'embedding')} AS x FROM c, embeddings WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = c.user_id AND a.doc_id = vec_id))) WHERE n <= 48),
{faceted('near')}, {POPULAR} {ranked(f"SELECT user_id, doc_id, 0.7::DOUBLE * sem / max(sem) OVER (PARTITION BY user_id) + 0.3::DOUBLE * raw / (raw + 3) AS score, {REASON}, best_author, 0 AS tier FROM fs UNION ALL SELECT *, 2 FROM p")}""")
def recommend_cascade(spark, d):
    return recommended(spark, d, 0)


@query(f"""WITH {AFFINITY}, {USERS}, {LIKED}, h AS (SELECT user_id, vec_id AS doc_id FROM wa JOIN embeddings USING (label) UNION SELECT user_id, doc_id FROM wc JOIN documents USING (source)),
cut AS (SELECT * FROM (SELECT user_id, doc_id, 0 AS sem, row_number() OVER (PARTITION BY user_id ORDER BY doc_id) AS n FROM h WHERE doc_id IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = h.user_id AND a.doc_id = h.doc_id)) WHERE n <= 48),
{faceted('cut')}, {POPULAR} {ranked(f"SELECT user_id, doc_id, raw / (raw + 3) AS score, {REASON}, best_author, 1 AS tier FROM fs UNION ALL SELECT *, 2 FROM p")}""")
def recommend_by_facets(spark, d):
    """Documents that anybody has read are without vectors, so readers are served by facets."""
    return recommended(spark, d, 100)


@query(f"WITH {USERS}, l AS (SELECT doc_id, epoch(TIMESTAMP '2024-01-01' + to_hours((doc_id % 97)::INTEGER)) AS score FROM documents) {ranked('''SELECT user_id, doc_id, score, 'newest' AS reason, NULL::BIGINT AS best_author, 3 AS tier FROM u, l''')}")
def recommend_newest(spark, d):
    """Nobody has read anything yet."""
    a = affinities(spark, d).where("false")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("long").alias("author_id"))
    users = table(spark, d, "events").select("user_id").union(table(spark, d, "customer").select("c_custkey")).distinct().where("user_id % 20 = 0")
    docs = documents(spark, d).select("doc_id", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("doc_id") % 97) * 3600).alias("uploaded_at"))
    out = rec.recommend(users, a, docs, e.select("doc_id", "embedding"), e.select("doc_id", "author_id"), documents(spark, d).select("doc_id", F.xxhash64("source").alias("category_id")))
    # Counted from the session's own midnight, so that its time zone does not matter.
    shift = F.unix_timestamp(F.lit("2024-01-01 00:00:00")).cast("double") - 1704067200.0
    return out.withColumn("score", F.col("score") - shift).select("user_id", "doc_id", six("score"), "reason", "best_author", "tier", "rank")
