from quire.operators import geometry
from quire.sources import readers, sinks


def test_uploads_markdown_gazetteer_geojson(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.md").write_bytes(b"\xef\xbb\xbf{0}---\none\n{1}---\ntwo\r\nlines")
    (tmp_path / "up" / "b.exe").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in readers.uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {"a.md": None, "b.exe": "type"}
    assert [(r.page, r.content) for r in readers.markdown(spark, str(tmp_path / "up" / "a.md")).collect()] == [(1, "one"), (2, "two\nlines")]
    (tmp_path / "g.tsv").write_text("#c\ns\t1\tدمشق\t33.5\t36.3\tالشام:historic\n")
    places, names = readers.gazetteer(spark, str(tmp_path / "g.tsv"))
    assert names.count() == 2 and readers.load_places(places, places).count() == 1
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"id":"7","name":" ","title":"X"},"geometry":{"coordinates":[36.3,33.5]}},{"properties":{},"geometry":null}]}')
    r = readers.geojson(spark, str(tmp_path / "g.json")).collect()
    assert [(x.source_id, x.name, float(x.lat)) for x in r] == [("7", "X", 33.5)]


def test_index_and_csv(spark, tmp_path):
    sinks.write_index(spark.createDataFrame([(1, "a")], "doc_id long, title string"), str(tmp_path / "i"))
    sinks.write_index(spark.createDataFrame([(2, "b", 3)], "doc_id long, title string, extra int"), str(tmp_path / "i"), append=True)
    assert set(sinks.read_index(spark, str(tmp_path / "i")).columns) == {"doc_id", "title", "extra"}
    sinks.write_csv(spark.createDataFrame([('a"b', 1)], "t string, n int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().t == 'a"b'
    sinks.write_knowledge(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "k"))
    assert readers.knowledge(spark, str(tmp_path / "k"), "a int, b string", lines=True).first().a == 1


def test_cache_split(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    hit, miss = readers.cached(spark.createDataFrame([("a", "x")], "cache_key string, answer string"), wanted)
    assert hit.count() == 1 and miss.first().cache_key == "b"


def test_low_coverage_blocks_are_laid_out_evenly():
    rows, share = geometry.place("aa bb", [("zz", 0, 0, 5, 5)], (0, 0, 100, 10), rtl=True)
    assert share == 0 and [r[6] for r in rows] == [False, False] and rows[0][2] > rows[1][2]
