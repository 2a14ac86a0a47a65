"""Sources: tables, uploads, markdown, layout JSON, OCR pages, gazetteers, seeds, knowledge JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_text, markdown_pages, markdown_source, normalize
from ..operators.versioning import created, upserted

#: Extensions of uploads and their largest sizes in bytes.
UPLOADS = {"pdf": 50 << 20, "docx": 25 << 20, "doc": 25 << 20, "txt": 25 << 20, "epub": 25 << 20, "md": 10 << 20, "markdown": 10 << 20, "json": 10 << 20}
MAP_SCHEMA = "struct<children:array<struct<id:string,page:int,bbox:array<double>,children:array<struct<id:string,block_type:string,bbox:array<double>,html:string>>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-01, SRC-02: a table of a folder of Parquet tables; scans are partitioned, so there is no iteration to manage."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: files with their extension and why they are refused, if they are; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return judged_uploads(files)


def judged_uploads(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    most = F.try_element_at(F.create_map(*[F.lit(x) for p in UPLOADS.items() for x in p]), ext)
    return files.withColumns({"extension": ext, "refused": F.when(most.isNull(), "type").when(F.col("length") > most, "size").when(F.col("length") == 0, "empty")})


def mined_metadata(rows: DataFrame) -> DataFrame:
    """SRC-05: authors and keywords of extracted metadata (map<string,string>): split at ; or else at commas, repeats out."""
    def values(*keys: str) -> Column:
        first = F.coalesce(*[F.nullif(F.trim(F.try_element_at("metadata", F.lit(k))), F.lit("")) for k in keys])
        parts = F.when(first.contains(";"), F.split(first, ";")).otherwise(F.split(first, ","))
        return F.array_distinct(F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.withColumns({"authors": values("dc:creator", "Author", "meta:author", "creator"), "categories": values("meta:keyword", "Keywords", "dc:subject", "subject")})


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06, STR-02: markdown files as pages, one page where there are no separators."""
    text = markdown_source("value")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), text.alias("content"))
    pages = F.coalesce(markdown_pages("content"), F.array(F.struct(F.lit(1).alias("page"), F.col("content").alias("content"))))
    return files.select("path", F.explode(pages).alias("p")).select("path", "p.page", "p.content")


def layout_pages(rows: DataFrame, json: str = "layout") -> DataFrame:
    """SRC-07, SRC-08, WIN-01: pages of layout JSON: blocks as text with running offsets, joined by line ends."""
    page = F.posexplode(F.from_json(json, MAP_SCHEMA).children).alias("_k", "p")
    blocks = rows.select("doc_id", page).select("doc_id", F.coalesce(F.col("p.page"), F.col("_k") + 1).alias("page"), F.col("p.bbox").alias("page_box"), F.posexplode("p.children").alias("pos", "b"))
    blocks = blocks.select("doc_id", "page", "page_box", "pos", F.col("b.id").alias("id"), F.col("b.block_type").alias("type"), F.col("b.bbox").alias("bbox"), html_text("b.html").alias("text"))
    before = Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    laid = blocks.withColumn("char_start", lo).withColumn("char_end", F.col("char_start") + F.length("text"))
    fields = ["pos", "id", "type", "bbox", "text", "char_start", "char_end"]
    whole = laid.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"), F.first("page_box").alias("page_box"))
    return whole.select("doc_id", "page", F.array_join(F.transform("blocks", lambda b: b.text), "\n").alias("content"), "blocks", (F.get("page_box", F.lit(2)) - F.get("page_box", F.lit(0))).alias("width"), (F.get("page_box", F.lit(3)) - F.get("page_box", F.lit(1))).alias("height"))


def ocr_pages(rows: DataFrame) -> DataFrame:
    """SRC-09: pages array<struct<page_number, text, markdown, tables>> of an OCR answer; blank ones out, numbers by place where missing."""
    out = rows.select("doc_id", F.posexplode("pages").alias("_k", "p"))
    return out.select("doc_id", F.coalesce(F.col("p.page_number"), F.col("_k") + 1).alias("page"), F.trim("p.text").alias("content"), F.col("p.markdown").alias("markdown"), F.col("p.tables").alias("tables")).where("content <> ''")


def gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-12: places (source, source_id, name, lat, lon) and their names of a TSV with variants 'name:kind|name:kind'."""
    schema = "source string, source_id string, name string, lat decimal(9,6), lon decimal(9,6), variants string"
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="DROPMALFORMED").where("source_id IS NOT NULL")
    return rows.drop("variants"), gazetteer_names(rows)


def gazetteer_names(rows: DataFrame) -> DataFrame:
    own = rows.select("source", "source_id", F.col("name").alias("v"))
    more = rows.select("source", "source_id", F.explode(F.split(F.coalesce("variants", F.lit("")), r"\|")).alias("v"))
    kind = F.nullif(F.regexp_extract("v", r":([a-z]+)$", 1), F.lit(""))
    both = own.unionByName(more).select("source", "source_id", normalize(F.trim(F.regexp_replace("v", r":[a-z]+$", ""))).alias("normalized"), F.coalesce(kind, F.lit("name")).alias("kind"))
    return both.where("normalized <> ''").dropDuplicates(["source", "source_id", "normalized"])


def load_places(places: DataFrame, rows: DataFrame) -> DataFrame:
    """SRC-12: an upsert by (source, source_id), so loading again changes nothing."""
    return upserted(places, rows, ["source", "source_id"])


def geojson(spark: SparkSession, path: str, names: tuple[str, ...] = ("name", "title", "names"), ids: tuple[str, ...] = ("id", "uri")) -> DataFrame:
    """SRC-13: places of a GeoJSON file; the first name and id property that is not blank, features without either out."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<coordinates:array<double>>>>"
    f = spark.read.json(path, multiLine=True, schema=schema).select(F.explode("features").alias("f")).select("f.properties", "f.geometry.coordinates")
    first = lambda keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at("properties", F.lit(k))), F.lit("")) for k in keys])
    return f.select(first(ids).alias("source_id"), first(names).alias("name"), F.get("coordinates", F.lit(1)).cast("decimal(9,6)").alias("lat"), F.get("coordinates", F.lit(0)).cast("decimal(9,6)").alias("lon")).where("source_id IS NOT NULL AND name IS NOT NULL")


def seeded_persons(persons: DataFrame, authors: DataFrame) -> DataFrame:
    """SRC-14: a person for each author that has none of the name."""
    from ..functions.text import blocking_key

    new = authors.select(F.col("name").alias("display_name"), F.col("alternate_names").alias("aliases"), blocking_key(normalize("name")).alias("blocking_key"), "death_year_hijri")
    return created(persons, new, ["display_name"])


def seeded_works(works: DataFrame, docs: DataFrame) -> DataFrame:
    """SRC-14: a work for each title."""
    return created(works, docs.select(normalize("title").alias("normalized_title"), "title").dropDuplicates(["normalized_title"]), ["normalized_title"])


def knowledge(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """SRC-15: knowledge JSON, one document a file, or one a line as sinks.write_knowledge has it."""
    return spark.read.json(path, multiLine=not lines, schema=schema)


def cache_key(*parts: str) -> Column:
    """SRC-16: the content address of a call."""
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def cached(answers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-16: wanted calls that have an answer, and those that have none yet."""
    return wanted.join(answers, "cache_key"), wanted.join(answers, "cache_key", "left_anti")
