"""Queries of streams, sources and sinks: each writes to the shared scratch folder and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from ..sources import readers, sinks
from ..sources.readers import table
from ..sources.scratch import kept, scratch
from ..streaming import events as stm
from .tables import AFFINITY, EVENT, documents, query, six, six_sql


def arriving(spark, d):
    """The events as a stream of files in a folder."""
    events = table(spark, d, "events")
    return spark.readStream.schema(events.schema).parquet(kept(spark, f"events of {d}", lambda path: events.write.parquet(path)))


def stream(spark, d):
    """The stream with the fields that clients and servers send; `k` of the properties is the document."""
    e = arriving(spark, d)
    kind = F.when(F.col("event_type") == "click", "bookmark_add").when(F.col("event_type") == "error", "bookmark_remove").when(F.col("event_type") == "view", "document_open").otherwise("reading_session")
    meta = F.to_json(F.struct((F.col("value") * 1000).cast("long").cast("string").alias("read_ms"), F.floor("value").cast("string").alias("pages_read"), (F.col("value") / 100).cast("string").alias("percent")))
    return e.select("event_id", "user_id", kind.alias("event_type"), F.get_json_object("props", "$.k").cast("long").alias("doc_id"), meta.alias("metadata"), F.col("ts").cast("timestamp").alias("created_at"), "value", F.col("event_type").alias("kind"), "ts")


def drained(spark, rows, mode="append"):
    """What a stream leaves in its table once it has read all that there is."""
    path = scratch(spark)
    stm.into_table(rows, f"{path}/table", f"{path}/state", mode=mode).awaitTermination()
    out = spark.read.parquet(f"{path}/table")
    if mode == "append":
        return out
    last = out.agg(F.max("batch")).first()[0]  # a complete table is written anew in each batch
    return out.where(F.col("batch") == last).drop("batch") if mode == "complete" else out.drop("batch")


@query("SELECT event_id, user_id, event_type, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS metadata FROM (SELECT event_id, user_id, props, CASE event_type WHEN 'view' THEN 'reading_session' WHEN 'click' THEN 'suggestion_select' WHEN 'purchase' THEN 'filter_apply' END AS event_type FROM events) WHERE event_type IS NOT NULL")
def stream_ingested(spark, d):
    e = arriving(spark, d)
    kind = F.when(F.col("event_type") == "view", "reading_session").when(F.col("event_type") == "click", "suggestion_select").when(F.col("event_type") == "purchase", "filter_apply").otherwise("document_open")
    return drained(spark, stm.ingested(e.select("event_id", "user_id", kind.alias("event_type"), F.col("props").alias("metadata"))))


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) <= 50)")
def request_batches(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type")).alias("events"))
    return stm.exploded_requests(r).select("user_id", "event_id")


@query(f"WITH {EVENT} SELECT user_id, doc_id, CASE event_type WHEN 'document_open' THEN 'note_add' ELSE event_type END AS event_type FROM e WHERE event_type <> 'reading_session'")
def stream_derived(spark, d):
    s = stream(spark, d)
    mark = F.col("event_type").isin("bookmark_add", "bookmark_remove")
    changes = s.select(F.when(mark, "bookmark").when(F.col("event_type") == "document_open", "note").otherwise("note").alias("table"), F.when(F.col("event_type") == "bookmark_remove", "delete").when(F.col("event_type") == "reading_session", "update").otherwise("insert").alias("op"), "user_id", "doc_id", F.col("created_at").alias("at"))
    return drained(spark, stm.derived(changes)).select("user_id", "doc_id", "event_type")


@query(f"WITH {AFFINITY} SELECT user_id, doc_id, open_count, total_read_ms, pages_read, {six_sql('percent_complete', 'percent_complete')} FROM a")
def stream_counters(spark, d):
    return drained(spark, stm.counters(stream(spark, d)), "complete").select("user_id", "doc_id", "open_count", "total_read_ms", "pages_read", six("percent_complete"))


@query(f"WITH {AFFINITY} SELECT user_id, doc_id, bookmark_count::BIGINT AS bookmark_count FROM b WHERE doc_id IS NOT NULL")
def stream_bookmarks(spark, d):
    return drained(spark, stm.fold(stream(spark, d)), "update").groupBy("user_id", "doc_id").agg(F.max_by("bookmark_count", F.lit(0)).alias("bookmark_count"))


@query(f"WITH {AFFINITY} SELECT user_id, doc_id, {six_sql('engagement_score', 'engagement_score')} FROM a")
def stream_engagement(spark, d):
    counted = drained(spark, stm.counters(stream(spark, d)), "complete")
    marked = drained(spark, stm.fold(stream(spark, d)), "update")
    return stm.scored(counted, marked).select("user_id", "doc_id", six("engagement_score"))


@query("SELECT event_id, user_id FROM events")
def stream_repeats_once(spark, d):
    """Every event is sent twice, and some much later than the first time but within the watermark's delay."""
    s = stream(spark, d).select("event_id", "user_id", "created_at")
    again = stream(spark, d).select("event_id", "user_id", (F.col("created_at") + F.expr("INTERVAL 20 MINUTES")).alias("created_at"))
    return drained(spark, stm.once(s.unionByName(again), "45 days")).select("event_id", "user_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily(spark, d):
    e = arriving(spark, d)
    return drained(spark, stm.windowed(e, "1 day"), "complete").select("start", "event_type", "n")


@query("SELECT user_id, 's' || (event_id % 7) AS session_id, min(ts) AS start, max(ts) AS stop, count(*) AS events FROM events GROUP BY 1, 2")
def client_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.concat(F.lit("s"), F.col("event_id") % 7).alias("session_id"), F.col("ts").alias("created_at"))
    return stm.client_sessions(e).withColumnRenamed("end", "stop")


@query("SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def stream_enriched(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return drained(spark, stm.enriched(stream(spark, d).select("event_id", "user_id"), people, "user_id")).select("event_id", "c_name")


# Sources and sinks, there and back.


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part")
def knowledge_round_trip(spark, d):
    path = scratch(spark)
    sinks.write_knowledge(table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size")), path)
    return readers.knowledge(spark, path, "p_partkey long, p_name string, p_size int", lines=True)


@query("SELECT doc_id, lang, NULL::BIGINT AS n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = 1")
def index_rows_added(spark, d):
    """Rows of an index, then rows with a column that it did not have."""
    path = scratch(spark)
    docs = documents(spark, d)
    sinks.write_index(docs.where("doc_id % 2 = 0").select("doc_id", "lang"), path)
    sinks.write_index(docs.where("doc_id % 2 = 1").select("doc_id", "lang", "n_chars"), path, append=True)
    return sinks.read_index(spark, path).select("doc_id", "lang", "n_chars")


@query("SELECT conv_id, turn, text FROM conversations")
def csv_round_trip(spark, d):
    path = scratch(spark)
    sinks.write_csv(table(spark, d, "conversations").select("conv_id", "turn", "text"), path)
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="conv_id long, turn long, text string")


@query("SELECT doc_id, sha256(lang || chr(31) || source) AS cache_key, source IN ('src1', 'src2', 'src3') AS hit FROM documents")
def cached_calls(spark, d):
    wanted = documents(spark, d).select("doc_id", "source", readers.cache_key("lang", "source").alias("cache_key"))
    answers = wanted.where("source IN ('src1', 'src2', 'src3')").select("cache_key").distinct()
    hit, miss = readers.cached(answers, wanted)
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False))).select("doc_id", "cache_key", "hit")


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'uri' || s_suppkey ELSE s_suppkey::VARCHAR END AS source_id, s_name AS name, (s_nationkey + 0.5)::DOUBLE AS lat, (s_suppkey % 180)::DOUBLE AS lon FROM supplier WHERE s_suppkey % 5 > 0")
def geojson_places(spark, d):
    """Every third place has its id under another property, every fifth has no name at all."""
    path, s = scratch(spark), table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    names = F.when(F.col("s_suppkey") % 5 == 0, F.create_map(F.lit("name"), F.lit(" "))).otherwise(F.create_map(F.lit("name"), F.lit(""), F.lit("title"), F.col("s_name")))
    ids = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("uri"), F.concat(F.lit("uri"), key))).otherwise(F.create_map(F.lit("id"), key))
    spot = F.struct(F.array((F.col("s_suppkey") % 180).cast("double"), (F.col("s_nationkey") + F.lit(0.5)).cast("double")).alias("coordinates"))
    one = s.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(F.map_concat(names, ids).alias("properties"), spot.alias("geometry"))).alias("features"))).alias("value"))
    one.repartition(max(1, s.count())).write.option("maxRecordsPerFile", 1).text(path)  # a file for each collection
    out = readers.geojson(spark, path)
    return out.select("source_id", "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


@query("SELECT name, formats, words, available FROM (VALUES ('deep', 'pdf', true, true), ('tika', 'pdf,docx', false, false)) t(name, formats, words, available)")
def engines_listed(spark, d):
    e = lookups.Engines()
    e.register("tika", "http://one", ("pdf", "docx"))
    e.register("deep", "http://two", ("pdf",), words=True)
    rows = [(x["name"], ",".join(x["formats"]), x["words"], x["available"]) for x in e.listing({"deep"})]
    return spark.createDataFrame(rows, "name string, formats string, words boolean, available boolean")
