"""Files on disk: saved pages, images, reports, logs, catalogue, streams."""

from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from catalog_engine.operators import similar
from catalog_engine.sources import catalog, files, sinks
from catalog_engine.streaming import incremental


def png(rows, comment=b""):
    """Grey eight-bit PNG from rows of numbers."""

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    extra = chunk(b"tEXt", b"Comment\0" + comment) if comment else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", data) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    root = tmp_path_factory.mktemp("html") / "owner" / "coin_5" / "images"
    root.mkdir(parents=True)
    falling = [[250 - 20 * x for x in range(9)] for _ in range(8)]
    rising = [[20 * x for x in range(9)] for _ in range(8)]
    (root / "a.png").write_bytes(png(falling))
    (root / "b.png").write_bytes(png(falling, b"other metadata"))
    (root / "c.png").write_bytes(png(rising))
    (root / "broken.png").write_bytes(png(falling)[:40])
    return root


def test_images(spark, pictures):
    images = files.scan_images(spark, str(pictures)).withColumn("file", F.substring_index("image.origin", "/", -1))
    rows = {r["file"]: r for r in images.select("file", similar.pixel_hash("image").alias("pixels"), "image.height").collect()}
    assert rows["a.png"]["pixels"] == rows["b.png"]["pixels"] != rows["c.png"]["pixels"]
    assert rows["broken.png"]["pixels"] is None and rows["broken.png"]["height"] == -1
    broken = similar.broken_images(images).collect()
    assert [tuple(r) for r in broken] == [("owner", "coin", 5, "broken.png")]


def test_difference_hash_of_gradients(spark, pictures):
    images = files.scan_images(spark, str(pictures)).filter("image.height > 0")
    for mode in ("luma", "average", "blue"):
        cells = images.select(F.substring_index("image.origin", "/", -1).alias("f"), similar.resample(mode)("image").alias("cells"))
        bits = {r["f"]: r["b"] for r in cells.select("f", F.bit_count(similar.dhash64("cells", stretch=False)).alias("b")).collect()}
        assert bits == {"a.png": 64, "b.png": 64, "c.png": 0}
        # the clipped ends tie with their neighbours
        stretched = {r["f"]: r["b"] for r in cells.select("f", F.bit_count(similar.dhash64("cells")).alias("b")).collect()}
        assert stretched["c.png"] == 0 and 0 < stretched["a.png"] <= 64
    left = similar.resample("blue", 0.0, 0.5)
    assert images.select(F.size(left("image"))).distinct().first()[0] == 72


def test_saved_pages(spark, tmp_path):
    for folder in ("alpha/coin_a_12", "alpha/not_numbered", "beta/x_7"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "page.html").write_text("<h1>é</h1>", encoding="utf-8")
        (tmp_path / folder / "pic.JPG").write_bytes(b"123")
    pages = files.scan_documents(spark, str(tmp_path)).orderBy("entity_id").collect()
    assert [(r["group"], r["slug"], r["entity_id"], r["text"]) for r in pages] == [("beta", "x", 7, "<h1>é</h1>"), ("alpha", "coin_a", 12, "<h1>é</h1>")]
    listing = files.scan_listing(spark, str(tmp_path), ["jpg"]).collect()
    assert len(listing) == 3 and {(r["name"], r["name_key"], r["length"]) for r in listing} == {("pic.JPG", "pic.jpg", 3)}
    assert "content" not in files.scan_listing(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().output().mkString(",")


def test_json_forms(spark, tmp_path):
    rows = [{"a": 1}, {"a": 2}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "object.json").write_text(json.dumps(rows[0], indent=1))
    read = lambda name: sorted(r["a"] for r in files.read_json_rows(spark, str(tmp_path / name)).collect())
    assert (read("lines.json"), read("array.json"), read("object.json")) == ([1, 2], [1, 2], [1])


def test_csv_with_a_repeated_header(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text('id,flag,name,flag,tags\n82,0,"Conf, A",FALSE,"90,7"\n')
    row = files.read_catalog_csv(spark, str(tmp_path / "nodes.csv"), "id long, flag int, name string, flag2 boolean, tags string").first()
    assert tuple(row) == (82, 0, "Conf, A", False, "90,7")


def test_progress_log(spark, tmp_path):
    (tmp_path / "pages.log").write_text("albania,1\nalbania,2\nbelgium, 1\n")
    assert tuple(files.last_entry(files.read_progress_log(spark, str(tmp_path / "pages.log"))).first()) == ("belgium", 1)
    (tmp_path / "bad.log").write_text("albania\n")
    with pytest.raises(Exception, match="bad progress line"):
        files.read_progress_log(spark, str(tmp_path / "bad.log")).collect()


def test_catalogue(spark):
    spark.range(3).select("id", F.lit("x").alias("name")).createOrReplaceTempView("things")
    spark.sql("CREATE OR REPLACE VIEW few AS SELECT id FROM range(3) WHERE id < 2")
    assert "things" in [r["name"] for r in catalog.list_tables(spark).collect()]
    assert [tuple(r) for r in catalog.table_schema(spark, "things").collect()] == [(0, "id", "bigint", False), (1, "name", "string", False)]
    assert "id < 2" in catalog.view_definition(spark, "few")
    assert catalog.view_definition(spark, "things") is None
    spark.sql("DROP VIEW few")
    assert catalog.database_info(spark).first()["version"] == spark.version
    with pytest.raises(ValueError, match="invalid name"):
        catalog.table_schema(spark, "things; DROP TABLE x")
    with pytest.raises(PySparkException):
        catalog.run_sql(spark, "SELECT nothing FROM nowhere")


def test_publish_over_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.publish(spark.range(3), path)
    sinks.publish(spark.read.parquet(path).union(spark.range(10, 12)), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 10, 11]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb"), (2, None)], "id int, text string")
    for fmt in ("csv", "log", "json", "parquet"):
        sinks.write_report(rows, str(tmp_path / fmt), fmt)
    lines = [line for p in (tmp_path / "json").glob("*.json") for line in p.read_text().splitlines()]
    assert sorted(lines) == ['{"id":1,"text":"a\\tb"}', '{"id":2,"text":null}']
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write_report(rows, str(tmp_path / "x"), "xls")


def test_streams_take_each_file_once(spark, tmp_path):
    inbox, target, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    spark.range(5).write.parquet(inbox)
    schema = spark.range(1).schema
    load = lambda: incremental.ingest_incremental(incremental.file_stream(spark, inbox, schema), target, progress)
    load()
    load()
    assert spark.read.parquet(target).count() == 5
    spark.range(5, 8).write.mode("append").parquet(inbox)
    load()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(8))


def upserted(spark, tmp_path, *batches):
    """Start a bucketed table of four rows and a folder with one file per batch."""
    inbox, target = str(tmp_path / "in"), str(tmp_path / "state")
    for rows in batches:
        spark.createDataFrame(rows, "k long, v string, seq int").coalesce(1).write.mode("append").parquet(inbox)
    start = spark.createDataFrame([(1, "first", 0), (7, "kept", 0), (8, "kept", 0), (9, "kept", 0)], "k long, v string, seq int")
    sinks.publish_buckets(sinks.in_buckets(start, ["k"], 64), target, ["k"])
    return incremental.file_stream(spark, inbox, spark.read.parquet(inbox).schema, files_per_batch=1), target


def state_of(spark, target):
    return sorted(map(tuple, sinks.read_buckets(spark, target).select("k", "v").collect()))


AFTER = [(1, "new"), (2, "b"), (7, "kept"), (8, "kept"), (9, "kept")]


def test_stream_upsert_replays_safely(spark, tmp_path):
    stream, target = upserted(spark, tmp_path, [(1, "new", 2), (1, "old", 1), (2, "b", 1)])
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "state").glob("*/*/*.parquet")}
    for progress in ("p1", "p2", "p3"):  # the later runs replay everything
        incremental.stream_upsert(stream, target, ["k"], ["v"], str(tmp_path / progress), "seq")
    assert state_of(spark, target) == AFTER
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "state").glob("*/*/*.parquet")}
    assert len(before.items() & after.items()) == 3  # buckets without news are left alone
    assert all(len(list(p.glob("version=*"))) <= 2 for p in (tmp_path / "state").glob("bucket=*"))


def test_stream_upsert_ignores_late_older_rows(spark, tmp_path):
    stream, target = upserted(spark, tmp_path, [(1, "new", 2), (2, "b", 1)], [(1, "old", 1)])
    incremental.stream_upsert(stream, target, ["k"], ["v"], str(tmp_path / "p"), "seq")
    assert state_of(spark, target) == AFTER


@pytest.mark.parametrize("stop", range(2))
def test_stream_upsert_stopped_between_renames(spark, tmp_path, monkeypatch, stop):
    """A batch that dies after some of its buckets were published leaves every row readable and can be replayed."""
    stream, target = upserted(spark, tmp_path, [(1, "new", 2), (2, "b", 1)])
    real, calls = sinks._folders, []

    def dying(fs, folder, label):
        names = real(fs, folder, label)
        if ".new-" not in folder.toString():
            return names

        def some():
            for i, name in enumerate(names):
                if i == stop and not calls:
                    calls.append(name)
                    raise RuntimeError("executor lost")
                yield name

        return some()

    monkeypatch.setattr(sinks, "_folders", dying)
    with pytest.raises(Exception, match="executor lost"):
        incremental.stream_upsert(stream, target, ["k"], ["v"], str(tmp_path / "p"), "seq")
    assert {k for k, _ in state_of(spark, target)} >= {1, 7, 8, 9}
    incremental.stream_upsert(stream, target, ["k"], ["v"], str(tmp_path / "p"), "seq")
    assert state_of(spark, target) == AFTER


def test_stream_dedup_with_event_time(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows = spark.range(20).select((F.col("id") % 4).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.coalesce(1).write.parquet(inbox)
    unique = incremental.stream_dedup(incremental.file_stream(spark, inbox, rows.schema), ["k"], "ts", "1 hour")
    incremental.ingest_incremental(unique, str(tmp_path / "out"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_every_json_file_is_judged_by_itself(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1},\n {"k": 2}]')
    (tmp_path / "b.json").write_text('{"k": 3}\n{"k": 4}\n')
    assert sorted(r["k"] for r in files.read_json_rows(spark, str(tmp_path), "k long").collect()) == [1, 2, 3, 4]


def test_csv_with_doubled_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""b"", c"\n2,"two\nlines"\n')
    assert [tuple(r) for r in files.read_catalog_csv(spark, str(tmp_path), "id long, name string").orderBy("id").collect()] == [(1, 'a "b", c'), (2, "two\nlines")]


def test_saved_files_are_written_by_several_tasks(spark):
    from catalog_engine.plans.bind_sources import saved_files
    from catalog_engine.plans.binding import Tables

    written = files.scan_listing(spark, saved_files(Tables(spark, "/root/testdata/sf0.001")), ["txt"])
    assert written.select(F.substring("name", 1, 10)).distinct().count() > 1
