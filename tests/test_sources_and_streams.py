"""Readers, publication, retained stages and streams on files of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewright.sources import publish, readers
from tracewright.streaming import events


def test_geojson_lines(spark, tmp_path):
    path = tmp_path / "f.geojson"
    path.write_text('{"type":"FeatureCollection","features":[\n{"type":"Feature","id":"a","properties":{"n":"1"},"geometry":{"type":"LineString","coordinates":[[0,1],[2.5,3]]}},\n{"type":"Feature","id":"b","properties":{},"geometry":null},\n{"type":"Feature","id":"c","properties":{"x":NaN},"geometry":{"type":"Point","coordinates":[1,2]}}\n]}\n')
    good, bad = readers.read_geojson_lines(spark, str(path))
    row = good.select("feature_id", readers.line_points().alias("p")).first()
    assert row.feature_id == "a" and [(p.x, p.y) for p in row.p] == [(0.0, 1.0), (2.5, 3.0)]
    assert sorted(r.reason for r in bad.collect()) == ["no-geometry", "not-finite"]


def test_geojson_on_one_line_and_odd_lines(spark, tmp_path):
    path = tmp_path / "g.geojson"
    one = '{"type":"Feature","id":"%s","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}'
    path.write_text('{"type":"FeatureCollection","name":"x","features":[' + one % "a" + "," + one % "b" + "]}\nnot json\n{\"type\":\"Featur\n" + one % "c" + "\n")
    good, bad = readers.read_geojson_lines(spark, str(path))
    assert sorted(r.feature_id for r in good.collect()) == ["a", "b", "c"]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("not json", "malformed"), ('{"type":"Featur', "malformed")]


def test_publish_when_the_new_folder_cannot_take_its_place(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    publish.publish(spark, {"one": spark.range(3)}, target)
    real = publish._fs

    class Refusing:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if ".staged-" in a.toString() else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(publish, "_fs", lambda s, p: (Refusing(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError):
        publish.publish(spark, {"one": spark.range(9)}, target)
    assert spark.read.parquet(f"{target}/one").count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_manifest_names_are_paths(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / "s" / folder).mkdir(parents=True)
        (tmp_path / "s" / folder / "x.txt").write_text(folder)
    assert sorted(r.name for r in publish.manifest(spark, str(tmp_path / "s")).collect()) == ["a/x.txt", "b/x.txt"]


def test_traffic_counts(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("count_point_id,observation_year,direction_of_travel,easting,northing,latitude,longitude,road_name,all_motor_vehicles\n 7 ,2020,N,365000,165000,,,A4,100\n8,x,S,,,51.4,-2.4,A4,\n,2020,N,1,1,,,A4,5\n9,2020,N,,,,,A4,5\n")
    got = {r.road_name + str(r.count_point_id): (r.disposition, r.cell_x, r.observation_year) for r in readers.read_traffic_counts(spark, str(path)).collect()}
    assert got == {"A47": ("usable", 36, 2020), "A48": ("no-count", 37, None), "A4None": ("no-identity", 0, 2020), "A49": ("no-location", None, 2020)}


def test_osm_ways(spark, tmp_path):
    path = tmp_path / "m.xml"
    path.write_text('<osm><node id="1" lat="51" lon="-2"/><node id="2" lat="52" lon="-3"/><way id="9"><nd ref="2"/><nd ref="1"/><nd ref="5"/><tag k="highway" v=" primary "/></way></osm>')
    row = readers.read_osm_ways(spark, str(path)).first()
    assert (row.way_id, row.tags, row.missing_nodes) == (9, {"highway": "primary"}, 1) and [(p.x, p.y) for p in row.points] == [(-3.0, 52.0), (-2.0, 51.0)]


def test_strict_key_join(spark):
    a = spark.createDataFrame([(1, "x")], "k long, a string")
    assert readers.strict_key_join("k", one=a, two=a.withColumnRenamed("a", "b")).first() == (1, "x", "x")
    with pytest.raises(Exception, match="not in every table once"):
        readers.strict_key_join("k", one=a, two=a.limit(0).withColumnRenamed("a", "b")).collect()


def test_publish_swaps_or_leaves(spark, tmp_path):
    target = str(tmp_path / "out")
    publish.publish(spark, {"one": spark.range(3)}, target)
    assert spark.read.parquet(f"{target}/one").count() == 3
    with pytest.raises(RuntimeError):
        publish.publish(spark, {"one": spark.range(9)}, target, validate=lambda staged: (_ for _ in ()).throw(RuntimeError("no")))
    assert spark.read.parquet(f"{target}/one").count() == 3
    publish.publish(spark, {"one": spark.range(4).withColumn("c", F.col("id") % 2)}, target, {"one": ["c"]})
    assert spark.read.parquet(f"{target}/one").count() == 4 and len(list(tmp_path.iterdir())) == 1


def test_manifest_and_retained_stages(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("a")
    before = spark.createDataFrame(publish.manifest(spark, str(tmp_path / "s")).collect())
    assert publish.verify(spark, str(tmp_path / "s"), before).count() == 0
    (tmp_path / "s" / "a.txt").write_text("b")
    (tmp_path / "s" / "c.txt").write_text("c")
    assert sorted(map(tuple, publish.verify(spark, str(tmp_path / "s"), before).collect())) == [("a.txt", "changed"), ("c.txt", "added")]
    stages, calls = publish.RetainedStages(spark, str(tmp_path / "r")), []
    make = lambda: calls.append(1) or spark.range(2)
    one = stages.get_or_make("x", {"a": 1}, [], make)
    two = stages.get_or_make("x", {"a": 1}, [], make)
    three = stages.get_or_make("x", {"a": 1}, [one[0]], make)
    assert (one[2], two[2], three[2], len(calls), two[1].count()) == (False, True, False, 2, 2)


def test_unreachable_artifacts_and_collection(spark):
    a = spark.createDataFrame([("a", ["b"]), ("b", []), ("c", ["b"])], "artifact_id string, upstream array<string>")
    assert [r.artifact_id for r in publish.unreachable(a, a.where("artifact_id = 'a'").select("artifact_id")).collect()] == ["c"]
    both = publish.network_collection({"x": spark.range(1), "y": spark.range(2).withColumn("n", F.lit(1))})
    assert {r.feature_type: r["count"] for r in both.groupBy("feature_type").count().collect()} == {"x": 1, "y": 2}


def test_status_changes_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("k", "a", t), ("k", "a", t + dt.timedelta(hours=1)), ("k", "b", t + dt.timedelta(hours=2)), ("j", "c", t)]
    spark.createDataFrame(rows, "id string, state string, recorded_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / "u.parquet"))
    stream = spark.readStream.schema("id string, state string, recorded_at timestamp").parquet(str(tmp_path / "in" / "u.parquet"))
    out = events.drain(events.status_changes(stream, "id"), "append").collect()
    assert len(out) == 3 and {(r.id, r.was, r.state) for r in out} == {("k", None, "a"), ("k", "a", "b"), ("j", None, "c")}


def test_streams_over_directories_of_part_files(spark, tmp_path):
    from tracewright.plans import stream

    at = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, at + dt.timedelta(hours=(i * 7) % 60), ("purchase", "error", "view")[i % 4 % 3], i / 2) for i in range(90)]
    kind = "event_id long, user_id long, ts timestamp, event_type string, value double"
    one, many = tmp_path / "one", tmp_path / "many"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "tmp"))
    one.mkdir()
    next((tmp_path / "tmp").glob("part-*")).rename(one / "events.parquet")
    spark.createDataFrame(rows, kind).repartition(5).write.parquet(str(many / "events.parquet"))
    for name, (query, _) in stream.PLANS.items():
        before = {t.name for t in spark.catalog.listTables()}
        want, got = query(spark, str(one)).collect(), query(spark, str(many)).collect()
        assert want and sorted(got, key=str) == sorted(want, key=str), name
        assert {t.name for t in spark.catalog.listTables()} == before, name
    states = events.effective_states(events.read_files(spark, str(many), "events.parquet", 1).select("user_id", F.lit(0).alias("dimension"), F.col("value").cast("long").alias("state"), events.verification(F.col("event_type")).alias("verification"), F.to_date("ts").alias("observed_on"), F.col("ts").alias("recorded_on"), F.col("event_id").alias("update_id")), ["user_id"])
    assert sorted(map(tuple, events.drain(states, "update", ["user_id"]).collect())) == sorted(map(tuple, events.drain(states).collect()))
