"""Sources and sinks on small files, and streams against their batch twins."""

import datetime
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.functions import geo
from tessera.operators import plan, raster, runs
from tessera.sources import readers, writers
from tessera.streaming import monitor


def png(pixels):
    """An 8-bit RGB image from rows of (r, g, b)."""
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_osm(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"a": "b"}}, {"type": "way", "id": 2, "nodes": [1, 9]}, {"type": "relation", "id": 3, "members": [{"type": "way", "ref": 2, "role": "outer"}]}]
    (tmp_path / "osm_g1_z11_5_6.json").write_text(json.dumps({"version": 0.6, "generator": "g", "elements": elements}))
    (tmp_path / "osm_g1_z11_5_7.json").write_text("{broken")
    nodes, ways, relations = readers.scan_osm(spark, str(tmp_path))
    assert nodes.first()["tags"] == {"a": "b"} and ways.first()["refs"] == [1, 9] and relations.first()["members"][0]["role"] == "outer"
    assert [(r["x"], r["y"]) for r in readers.osm_catalog(spark, str(tmp_path)).collect()] == [(5, 6)]


def test_rasters(spark, tmp_path):
    (tmp_path / "z13_x4_y5.png").write_bytes(png([[(128, 1, 128), (200, 2, 0)], [(0, 0, 0), (255, 255, 255)]]))
    (tmp_path / "z13_x4_y6.png").write_bytes(b"x")
    row = readers.scan_raster(spark, str(tmp_path)).collect()[0]
    assert (row["z"], row["x"], row["y"], row["width"]) == (13, 4, 5, 2)
    assert row["h"] == [1.5, 200 * 256 + 2 - 32768.0, -32768.0, 65535 + 255 / 256 - 32768]
    assert [r["y"] for r in readers.tile_catalog(spark, str(tmp_path), 13).collect()] == [5]


def test_large_raster(spark, tmp_path):
    """A tile of the usual size, every pixel."""
    pixel = lambda x, y: (128 + x % 4, (x * 7 + y) % 256, y)
    (tmp_path / "z13_x4_y5.png").write_bytes(png([[pixel(x, y) for x in range(256)] for y in range(256)]))
    h = readers.scan_raster(spark, str(tmp_path)).first()["h"]
    assert h == [r * 256 + g + b / 256 - 32768 for r, g, b in (pixel(x, y) for y in range(256) for x in range(256))]


def test_survey_from_image_files(spark, tmp_path):
    """Only the pixels of the stride are decoded, and the survey, facts and hole test are those of whole tiles."""
    for k, (w, h) in enumerate(((256, 256), (50, 37), (8, 8))):
        (tmp_path / f"z13_x{k}_y5.png").write_bytes(png([[(128 + (x * y + k) % 3, (x * 7 + y) % 256, y % 256) for x in range(w)] for y in range(h)]))
    (tmp_path / "z13_x9_y5.png").write_bytes(png([[(0, 0, 0)] * 64] * 64))
    for stride in (8, 32):
        sample = {r["x"]: r for r in readers.scan_raster(spark, str(tmp_path), stride).collect()}
        for r in readers.scan_raster(spark, str(tmp_path)).collect():
            some = [h for at, h in enumerate(r["h"]) if at // r["width"] % stride == 0 and at % r["width"] % stride == 0]
            assert sample[r["x"]]["h"] == some and sample[r["x"]]["width"] * sample[r["x"]]["height"] == len(some)
    whole, sampled = (readers.scan_raster(spark, str(tmp_path), k).where("x in (0, 9)") for k in (1, 8))
    square = whole.where("x = 0")
    assert raster.survey(sampled.where("x = 0"), 1, 1).collect() == raster.survey(square, 256, 8).collect()
    assert raster.tile_info(sampled, 1, 1).where("x = 0").collect() == raster.tile_info(square, 256, 8).collect()
    assert {r["x"]: r["hole"] for r in sampled.select("x", raster.is_hole("h", 1).alias("hole")).collect()} == {0: False, 9: True}


def test_from_map_files_to_baked_tiles(spark, tmp_path):
    """Two tile files with a shared way: the bake has every way whole in each of its tiles, border elements once, and reads back by box."""
    from tessera.plans import pipelines

    west = [{"type": "node", "id": 1, "lat": 45.0, "lon": 25.10, "tags": {"a": "b"}}, {"type": "way", "id": 9, "nodes": [1, 2], "tags": {"highway": "x"}}, {"type": "node", "id": 2, "lat": 45.0, "lon": 25.20}]
    east = [{"type": "node", "id": 2, "lat": 45.0, "lon": 25.20}, {"type": "way", "id": 9, "nodes": [1, 2], "tags": {"highway": "x"}}, {"type": "relation", "id": 5, "members": [{"type": "way", "ref": 9, "role": "outer"}]}]
    places = [r["x"] for r in spark.range(2).select(F.when(F.col("id") == 0, 25.10).otherwise(25.20).alias("lon")).select(geo.tile_x("lon", 11).alias("x")).collect()]
    y = spark.range(1).select(geo.tile_y(F.lit(45.0), 11)).first()[0]
    assert places[0] != places[1]
    for x, elements in zip(places, (west, east), strict=True):
        (tmp_path / f"osm_g1_z11_{x}_{y}.json").write_text(json.dumps({"version": 0.6, "generator": "g", "elements": elements}))
    counts = {r["x"]: tuple(r)[2:] for r in pipelines.bake_files(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert counts == {x: (1, 1, 1, 1, False) for x in places}
    for x, own in zip(places, (1, 2), strict=True):
        got = {(r["type"], r["id"]): r for r in writers.read_tiles(spark, str(tmp_path / "out"), 11, x, y, x, y).collect()}
        assert set(got) == {("node", 1), ("node", 2), ("way", 9), ("relation", 5)}
        assert got["way", 9]["refs"] == [1, 2] and got["way", 9]["tags"] == {"highway": "x"} and got["relation", 5]["members"][0]["ref"] == 9
        assert (got["node", 1]["tags"] == {"a": "b"}) == (own == 1)


def test_from_image_files_to_repaired_levels(spark, tmp_path):
    from tessera.plans import pipelines

    flat = lambda h: png([[((h + 32768) // 256, (h + 32768) % 256, 0)] * 8] * 8)
    hole = png([[(0, 0, 0)] * 8] * 8)
    for name, data in (("z13_x0_y0", flat(100)), ("z13_x1_y0", hole), ("z13_x8_y8", hole), ("z12_x0_y0", flat(40)), ("z11_x0_y0", flat(7)), ("z12_x4_y4", hole)):
        (tmp_path / f"{name}.png").write_bytes(data)
    got = {(r["z"], r["x"], r["y"]): r["h"] for r in pipelines.repair_files(spark, str(tmp_path), 13, 8, 1).collect()}
    assert got[13, 0, 0] == [100.0] * 64 and got[13, 1, 0] == [40.0] * 64 and (13, 8, 8) not in got
    assert got[12, 0, 0][0] == 100.0 and got[12, 0, 0][7] == 40.0
    survey = pipelines.survey_files(spark, str(tmp_path), 8).first()
    assert (survey["min_m"], survey["max_m"], survey["tiles"]) == (7.0, 100.0, 3)


def test_tiles_along_the_curve(spark, tmp_path):
    """A box of tiles is read from under a tenth of the files; a dense tile is split over several; rows are all there."""
    dense = spark.range(20_000).select(F.lit(11).alias("z"), F.lit(1170).alias("x"), F.lit(730).alias("y"), F.lit("node").alias("type"), F.col("id"))
    nodes = view(spark, "/root/testdata/sf0.1", "fx_node_tile").select(F.lit(11).alias("z"), "x", "y", F.lit("node").alias("type"), F.col("id") + 10**6)
    rows = dense.unionByName(nodes.toDF("z", "x", "y", "type", "id"))
    path = str(tmp_path / "tiles")
    writers.write_tiles(rows, path, files=16, levels=1)
    assert spark.read.parquet(path).count() == rows.count()
    spans = rows.agg(F.min("x"), F.min("y")).first()
    box = (spans[0] + 2, spans[1] + 2, spans[0] + 4, spans[1] + 3)
    got = writers.read_tiles(spark, path, 11, *box, levels=1)
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    assert sorted(map(tuple, got.select("x", "y", "id").collect())) == sorted(map(tuple, rows.where(inside).select("x", "y", "id").collect())) and got.count() > 0
    files = len(list((tmp_path / "tiles").rglob("*.parquet")))
    read = {r["f"] for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
    scanned = got._jdf.queryExecution().executedPlan().toString()
    assert len(read) * 10 < files and "PartitionFilters" in scanned and "block" in scanned.split("PartitionFilters")[1][:400]
    split = spark.read.parquet(path).where("x = 1170 and y = 730").select(F.input_file_name()).distinct().count()
    assert split > 1


def test_owned_regions_replace_themselves_alone(spark, tmp_path):
    path = str(tmp_path / "master")
    regions = lambda some: spark.createDataFrame(some, "sub string, reg_x int, reg_z int, v int")
    writers.merge_owned(regions([("region", x, z, 1) for x in range(-40, 40, 5) for z in range(-40, 40, 5)] + [("entities", 0, 0, 1)]), path)
    writers.merge_owned(regions([("region", 0, 0, 2), ("region", 0, 0, 3), ("region", 90, 0, 2)]), path)
    got = {}
    for r in spark.read.parquet(path).collect():
        got.setdefault((r["sub"], r["reg_x"], r["reg_z"]), []).append(r["v"])
    assert sorted(got.pop(("region", 0, 0))) == [2, 3] and got.pop(("region", 90, 0)) == [2]
    assert set(map(tuple, got.values())) == {(1,)} and len(got) == 16 * 16 and ("entities", 0, 0) in got
    assert len(list((tmp_path / "master").glob("folder_x=*/folder_z=*"))) < 20


def test_countries(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1]]
    features = [{"properties": {"name": "Aland"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"name": "BLAND"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}]
    (tmp_path / "c.json").write_text(json.dumps({"features": features}))
    got = readers.scan_countries(spark, str(tmp_path / "c.json"))
    assert got.where("name = 'aland'").count() == 3 and got.where("name = 'bland'").count() == 9
    assert [r["name"] for r in readers.country_names(got).collect()] == ["aland", "bland"]


def test_plan_trees_logs_worlds(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{"1,-2,4": "merged", "bad": "x", "0,0,64": "planned"}')
    assert {tuple(r) for r in readers.scan_plan(spark, str(tmp_path / "plan.json")).collect()} == {("1,-2,4", 1, -2, 4, "merged"), ("0,0,64", 0, 0, 64, "planned")}
    trees = {"realm": "fl", "communities": [{"name": "c", "habitat": "h", "density": 1, "species": [{"name": "s", "w1": ["a", "b"], "w2": ["c"], "w3": []}]}]}
    (tmp_path / "region.json").write_text(json.dumps(trees))
    models = readers.scan_trees(spark, str(tmp_path / "region.json"))
    assert {tuple(r) for r in models.select("tier", "model").collect()} == {("w1", "a"), ("w1", "b"), ("w2", "c")}
    assert runs.tier_stats(models).where("realm = 'ALL' and tier = 'w1'").first()["variants"] == 2
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/cell--1_2_4.log").write_text("a\nb\n\n" + "".join(f"{k}\n" for k in range(500)))
    (tmp_path / "logs/other.log").write_text("not a cell's")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)  # so that the log is read in many blocks
    got = sorted(map(tuple, readers.scan_logs(spark, str(tmp_path / "logs")).collect()), key=lambda r: r[1])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r[0] for r in got} == {"-1,2,4"} and len({r[1] for r in got}) == len(got) and [r[2] for r in got] == ["a", "b", ""] + [str(k) for k in range(500)]
    (tmp_path / "w.json").write_text('{"world": "w", "origin": {"lat": 1.0, "lon": 2.0, "locked": true}, "merged_cells": ["1,1,4"]}')
    assert readers.read_world_meta(spark, str(tmp_path / "w.json")).first()["origin"]["locked"]


def test_regions_packs_sources(spark, tmp_path):
    (tmp_path / "m/region").mkdir(parents=True)
    (tmp_path / "m/region/r.-3.7.mca").write_bytes(b"abc")
    assert tuple(readers.scan_regions(spark, str(tmp_path / "m")).first()) == ("region", -3, 7, 3)
    pack = {"region_id": "r", "name": "n", "zoom": 11, "bbox": {"south": 45.0, "west": 25.0, "north": 45.01, "east": 25.01}}
    (tmp_path / "p.json").write_text(json.dumps(pack))
    listed = readers.list_packs(spark, str(tmp_path / "p.json"), spark.createDataFrame([(11, 1166, 737)], "z int, x int, y int")).first()
    assert listed["total"] >= 1 and listed["pct"] in (0.0, 50.0, 100.0)
    (tmp_path / "p.json").write_text(json.dumps(pack | {"zoom": 9}))
    assert readers.list_packs(spark, str(tmp_path / "p.json"), spark.createDataFrame([(9, 291, 184)], "z int, x int, y int")).first()["pct"] == 100.0
    files = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, None)], "path string, length int, south double")
    assert {r["path"]: r["length"] for r in readers.scan_sources(files).collect()} == {"a": 2, "b": 1}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(11, 1, 1, "node", 5), (11, 1, 2, "way", 6), (11, 2, 1, "node", 7)], "z int, x int, y int, type string, id long")
    writers.write_tiles(rows, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 3
    assert {tuple(r) for r in writers.read_tiles(spark, str(tmp_path / "tiles"), 11, 1, 2, 1, 2).collect()} == {(1, 2, "way", 6, 11)}
    docs = {(r["x"], r["y"]): json.loads(r["value"]) for r in writers.tile_json(rows, "g").collect()}
    assert docs[(1, 2)]["elements"] == [{"type": "way", "id": 6}]
    ring = spark.createDataFrame([("a", 1, 10, 20, 1.23456789, 2.0), ("a", 0, 11, 21, 1.0, 2.0)], "zone string, seq int, x int, z int, lon double, lat double")
    writers.write_points(ring, str(tmp_path / "points"))
    assert "10,20,1.234568,2.000000" in "".join(p.read_text() for p in (tmp_path / "points").rglob("*.csv"))
    cells = spark.createDataFrame([("1,1,4", 1, 1, 4, "merged"), ("0,0,4", 0, 0, 4, "merged"), ("2,2,4", 2, 2, 4, "failed")], "cell_key string, rx int, rz int, size int, status string")
    assert writers.world_meta(cells, "w", 1.0, 2.0, True, {"b": "1", "a": "2"}).first()["merged_cells"] == ["0,0,4", "1,1,4"]
    regions = lambda v: spark.createDataFrame([(0, 0, v), (1, 0, v)], "reg_x int, reg_z int, v int")
    writers.merge_owned(regions(1), str(tmp_path / "master"))
    writers.merge_owned(regions(2).where("reg_x = 0"), str(tmp_path / "master"))
    assert {r["reg_x"]: r["v"] for r in spark.read.parquet(str(tmp_path / "master")).collect()} == {0: 2, 1: 1}
    writers.write_manifest(spark.createDataFrame([("r", "n")], "region_id string, name string"), str(tmp_path / "packs"))
    assert spark.read.json(str(tmp_path / "packs")).first()["updated"] > 0


def run_stream(frame, tmp_path, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


@pytest.fixture()
def events(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.where("event_id < 200").withColumn("band", F.when(F.col("event_id") % 5 == 0, "soft").otherwise("hard")).withColumn("mover", F.col("user_id") % 7)
    e = e.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in ("queued", "started", "merged", "failed")]), (F.col("event_id") % 4 + 1).cast("int")))
    e = e.withColumn("cell_key", (F.col("user_id") % 5).cast("string")).withColumn("worker", (F.col("user_id") % 3).cast("int")).withColumn("duration_s", F.col("value"))
    e = e.withColumn("run_id", F.col("user_id") % 2).withColumn("total", F.lit(20)).withColumn("reason", F.when(F.col("event_id") % 3 == 0, "network timeout").otherwise("disk full"))
    e = e.withColumn("active", F.col("event_id") % 9).withColumn("done", F.col("event_id")).withColumn("failed", F.lit(0)).withColumn("cpu", F.col("value")).withColumn("ram", F.col("value"))
    e = e.withColumn("line", F.when(F.col("event_id") % 4 < 2, "ERROR x").otherwise("ok")).withColumn("cell_id", F.col("user_id") % 2)
    ordered = e.orderBy("ts", "event_id").coalesce(1)
    ordered.write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def rows(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def in_time(batch, at="ts"):
    """What the last watermark, a minute before the last row, has passed."""
    now = batch.agg(F.max(F.unix_millis("ts"))).first()[0] - 60_000
    return batch.where(F.unix_micros(at) <= now * 1000), now * 1000


def test_streams_equal_batch(events, tmp_path):
    batch, stream = events
    seen, now = in_time(batch)
    got = run_stream(monitor.zone_transitions(stream), tmp_path, "moves")
    assert rows(got, "mover", "event_id", "before", "band") == rows(runs.zone_transitions(seen), "mover", "event_id", "before", "band")
    died = F.col("event_id") % 11 == 0
    got = run_stream(monitor.dwell_penalty(stream.withColumn("died", died), 3600.0), tmp_path, "dwell")
    assert rows(got, "mover", "at", "step", "penalty") == rows(runs.dwell_penalty(seen.withColumn("died", died), 3600.0, end=now), "mover", "at", "step", "penalty")
    got = run_stream(monitor.timeline(stream), tmp_path, "line")
    want = runs.timeline(batch).where(F.unix_micros("t") + 20_000_000 <= now)
    assert rows(got, "t", "active", "done", "cpu") == rows(want, "t", "active", "done", "cpu")
    got = run_stream(monitor.ewma(stream), tmp_path, "mean").groupBy("worker").agg(F.count("*").alias("n"))
    assert {r["worker"]: r["n"] for r in got.collect()} == {r["worker"]: r["count"] for r in seen.where("duration_s > 0").groupBy("worker").count().collect()}
    got = run_stream(monitor.lifecycle(stream, 1e9), tmp_path, "life")
    assert got.count() == seen.where("status in ('merged', 'failed')").count()
    latest = got.groupBy("cell_key").agg(F.max("attempts").alias("n"))
    assert {r["cell_key"]: r["n"] for r in latest.collect()}.items() <= {r["cell_key"]: r["attempts"] for r in runs.attempts(batch).collect()}.items() or latest.count() == 5


@pytest.fixture()
def delivered(spark, tmp_path):
    """Rows of three movers, ten seconds apart, in twelve files that are read one by one; rows come up to 50 seconds late, one comes an hour late."""
    rng = random.Random(5)
    start = datetime.datetime(2026, 1, 1)
    made = [(k, k % 3, start + datetime.timedelta(seconds=10 * k), "hard" if k % 13 else "soft", k % 31 == 0, ("queued", "started", "merged", "failed")[k // 3 % 4]) for k in range(240)]
    order = sorted(made, key=lambda r: (r[2] + datetime.timedelta(seconds=rng.uniform(0, 50)), r[0]))
    late = (999, 0, start - datetime.timedelta(hours=1), "soft", False, "merged")
    schema = "event_id long, mover long, ts timestamp, band string, died boolean, status string"
    for k in range(12):
        some = order[20 * k : 20 * k + 20] + [late] * (k == 8)
        spark.createDataFrame(some, schema).withColumn("cell_key", F.col("mover").cast("string")).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    batch = spark.read.parquet(str(tmp_path / "late")).where("event_id <> 999")
    return in_time(batch), spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))


def test_order_holds_across_micro_batches(delivered, tmp_path):
    (batch, now), stream = delivered
    got = run_stream(monitor.zone_transitions(stream), tmp_path, "moves_late")
    assert rows(got, "mover", "event_id", "before", "band") == rows(runs.zone_transitions(batch), "mover", "event_id", "before", "band")
    got = run_stream(monitor.dwell_penalty(stream, 25.0), tmp_path, "dwell_late")
    want = rows(runs.dwell_penalty(batch, 25.0, end=now), "mover", "at", "step", "penalty")
    assert rows(got, "mover", "at", "step", "penalty") == want and len(want) > 60
    got = run_stream(monitor.lifecycle(stream), tmp_path, "life_late")
    assert {r["duration_s"] for r in got.where("status = 'merged'").collect()} == {30.0}


def test_state_ends_with_silence(spark, tmp_path):
    """Retries are granted anew to a cell that was silent for long enough, and the state of silent keys goes."""
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    failures = [(k, "a", at(s), "failed", "timeout") for k, s in enumerate((0, 10, 20, 5000, 5010, 5020))] + [(9, "b", at(90_000), "failed", "disk full")]
    spark.createDataFrame(failures, "event_id long, cell_key string, ts timestamp, status string, reason string").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = run_stream(monitor.retries(stream, idle=3600.0), tmp_path, "ended")
    assert sorted((r["ts"], r["retry"]) for r in got.collect()) == [(at(0), 1), (at(10), 2), (at(5000), 1), (at(5010), 2)]
    left = spark.read.format("statestore").option("path", str(tmp_path / "cp-ended")).option("stateVarName", "state").load()
    assert left.count() == 0


def test_retries_and_ends(events, tmp_path):
    batch, stream = events
    again = run_stream(monitor.retries(stream.where("status = 'failed'"), idle=1e9), tmp_path, "again")
    assert again.groupBy("cell_key").count().where("count > 2").count() == 0 and again.count() > 0
    ends = run_stream(monitor.run_end(stream, 1e9), tmp_path, "ends")
    assert ends.count() == 2 and all(r["done"] + r["failed"] == 20 for r in ends.collect())


def test_tail_of_growing_logs(spark, tmp_path):
    """Two runs: a log that grows by a file goes on where it was, others come new; each line comes once, repeats in a row don't."""
    first = {"cell-1_-2_4.log": ["ok", "ERROR: out of memory", "ERROR: out of memory", "ok", "ERROR: still missing"], "notes.txt": ["ERROR: not a log"]}
    second = {"more/cell-1_-2_4.log": ["ERROR: still missing", "ERROR: panicked"], "cell-0_0_4.log": ["ERROR: panicked", "ok", "ERROR: panicked", "ERROR: x"]}
    got = []
    for files in (first, second):
        for name, lines in files.items():
            (tmp_path / "logs" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "logs" / name).write_text("".join(x + "\n" for x in lines))
        tail = monitor.log_tail(spark, str(tmp_path / "logs"))
        query = tail.writeStream.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination(120)
        got.append(sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("cell_key", "place", "line").collect()))
    assert got[0] == [("1,-2,4", 1, "ERROR: out of memory"), ("1,-2,4", 2, "ERROR: still missing")]
    assert got[1] == [("0,0,4", 1, "ERROR: panicked"), ("0,0,4", 2, "ERROR: x"), *got[0], ("1,-2,4", 3, "ERROR: panicked")]
    every = [(cell, n, line) for cell, lines in (("1,-2,4", first["cell-1_-2_4.log"] + second["more/cell-1_-2_4.log"]), ("0,0,4", second["cell-0_0_4.log"])) for n, line in enumerate(lines)]
    batch = runs.dedupe_runs(spark.createDataFrame(every, "cell_id string, line_no int, line string"))
    assert sorted((r["cell_id"], r["line"]) for r in batch.collect()) == sorted((k, line) for k, _, line in got[1])


def test_chunk_upsert_in_batches(spark, tmp_path):
    """Two micro-batches: the second writes anew only the buckets that it changes."""
    rows = lambda some: spark.createDataFrame(some, "id long, version long, status string")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long, version long, status string").parquet(str(tmp_path / "in"))
    for first, some in enumerate(([(k, 1, "a") for k in range(300)], [(5, 2, "b"), (6, 0, "old"), (300, 1, "new")])):
        rows(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        monitor.chunk_upsert(stream, str(tmp_path / "table")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    table = {r["id"]: r["status"] for r in monitor.latest_chunks(spark, str(tmp_path / "table"), stream.schema).collect()}
    assert table == {k: "a" for k in range(300)} | {5: "b", 300: "new"}
    assert len(list((tmp_path / "table/batch=1").glob("bucket=*"))) <= 3 < len(list((tmp_path / "table/batch=0").glob("bucket=*")))
    before = monitor.bucket_versions(spark, str(tmp_path / "table"))
    rows([(5, 3, "c")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # the next one removes what the second has superseded
    monitor.chunk_upsert(stream, str(tmp_path / "table")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    after = monitor.bucket_versions(spark, str(tmp_path / "table"))
    assert {v for v in before if v[1] == 0} - set(after) == {(k, 0) for k, b in before if b == 1} and (5, "c") in {(r["id"], r["status"]) for r in monitor.latest_chunks(spark, str(tmp_path / "table"), stream.schema).collect()}


def test_chunk_upsert(spark, events, tmp_path):
    batch, stream = events
    changes = stream.select((F.col("event_id") % 10).alias("id"), F.col("event_id").alias("version"), "status")
    monitor.chunk_upsert(changes, str(tmp_path / "table")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    table = monitor.latest_chunks(spark, str(tmp_path / "table"), changes.schema)
    assert table.count() == 10 and table.agg(F.min("version")).first()[0] >= 190 - 10
    state = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id int, version int, v string")
    assert {r["id"]: r["v"] for r in plan.upsert(state, spark.createDataFrame([(1, 2, "c"), (2, 4, "d")], state.schema), "id", "version").collect()} == {1: "c", 2: "b"}
