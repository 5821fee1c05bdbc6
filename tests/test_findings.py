"""Queries on tables that the small ones don't hold: boxes over a pole, many boxes, many keys."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.fixtures import TABLES
from tessera.operators import generate
from tessera.queries import ORACLE_SQL, QUERIES


def tables_with(sf_dir, folder, **frames):
    """The tables of ``sf_dir`` in ``folder``, some of them replaced."""
    for file in os.listdir(sf_dir):
        if file.split(".")[0] not in frames:
            os.symlink(f"{sf_dir}/{file}", folder / file)
    for name, frame in frames.items():
        frame.toPandas().to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    cursor = con.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, folder)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(tuple(r[columns.index(c)] for c in df.columns)) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want and want


def test_table_functions_do_not_join_boxes(spark, sf_dir):
    """Rows of a box come from the box itself; two generators in one FROM were joined, every box with every other one."""
    plan = QUERIES["boxes_in_sql"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Aggregate" not in plan


def test_table_function_of_a_box_over_a_pole(spark):
    generate.register_table_functions(spark)
    got = lambda south, north: spark.sql(f"SELECT * FROM tiles_for_box({south}D, 25D, {north}D, 25.01D, 11)").count()
    assert got(89.99, 90.05) == 0 and got(45.0, 45.01) == 1


@pytest.fixture(scope="module")
def over_a_pole(spark, sf_dir, tmp_path_factory):
    """Tables whose events have cells north of 89.9 degrees, some of them over the pole and some past it, beside the usual ones."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 400")
    far = events.where("event_id < 150").withColumns({"event_id": F.col("event_id") + 1000, "user_id": 12 * (737 + F.col("event_id") % 13 * F.when(F.col("event_id") % 2 == 0, 1).otherwise(45)) + F.col("event_id") % 12})
    return tables_with(sf_dir, tmp_path_factory.mktemp("pole"), events=events.unionByName(far))


@pytest.mark.parametrize("name", ["cells_served", "download_plan", "group_state", "pack_status"])
def test_cells_over_a_pole(spark, over_a_pole, name):
    same_as_sql(spark, over_a_pole, name)


def test_means_just_below_a_half(spark):
    """To one decimal as SQL has it: by the tenfold, which is a half here."""
    from tessera.operators import raster

    tiles = spark.createDataFrame([(13, 0, 0, [-55.849999999999994]), (13, 1, 0, [0.25]), (13, 2, 0, [7.04])], "z int, x int, y int, h array<double>")
    assert [r["mean_m"] for r in raster.tile_info(tiles, 1, 1).orderBy("x").collect()] == [-55.9, 0.3, 7.0]
    assert raster.survey(tiles, 1, 1).first()["min_m"] == -55.9


def test_many_manifests_lie_in_few_files(spark, tmp_path):
    """All are read again, from arrays and from files of their own alike."""
    from tessera.sources import readers, writers

    packs = spark.range(3000).select(
        F.col("id").cast("string").alias("region_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit(11).alias("zoom"),
        F.struct(*[F.lit(v).alias(s) for s, v in zip(generate.SIDES, (45.0, 25.0, 45.01, 25.01), strict=True)]).alias("bbox"),
    )
    writers.write_manifest(packs, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("part-*"))) <= 10
    writers.write_manifest(packs.where("id < 3").withColumn("region_id", F.concat(F.lit("x"), "region_id")), str(tmp_path / "p"), 1)
    assert len([f for f in (tmp_path / "p").glob("part-*") if f.read_text().startswith("{")]) == 3
    listed = readers.list_packs(spark, str(tmp_path / "p"), spark.createDataFrame([(11, 1166, 737)], "z int, x int, y int")).collect()
    assert len(listed) == 3003 and len({r["region_id"] for r in listed}) == 3003 and {r["pct"] for r in listed} == {listed[0]["pct"]}


def test_state_is_kept_by_slot(spark, tmp_path):
    """Thousands of movers make no more groups than there are slots, and each has its own last band."""
    from tessera.streaming import monitor

    seen = spark.range(9000).select((F.col("id") % 3000).alias("mover"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") < 6000, "soft").otherwise("hard").alias("band"))
    seen.coalesce(2).write.parquet(str(tmp_path / "in"))
    moves = monitor.zone_transitions(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")))
    query = moves.writeStream.format("memory").queryName("slots").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert spark.table("slots").count() == spark.table("slots").select("mover").distinct().count() == 2999  # the last one waits for the watermark
    due = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "due").load()
    assert due.count() <= monitor.SLOTS


def test_waiting_rows_are_kept_in_chunks(spark, tmp_path):
    """Rows that wait for the watermark are few values of the state store, and come out in order, nulls and late rows too."""
    from tessera.streaming import monitor

    def deliver(rows):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        moves = monitor.zone_transitions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        moves.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out")).awaitTermination(120)

    band = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "soft").otherwise("hard")
    mover = F.when(F.col("id") % 10 < 9, F.col("id") % 10)  # one in ten has none
    seen = spark.range(6000).select(mover.alias("mover"), F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("id") * 7919) % 6000 * 5).alias("ts"), F.col("id").alias("event_id"), band.alias("band"))
    deliver(seen)
    kept = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "waiting").load()
    assert 0 < kept.count() <= 20  # all 6000 rows of ten movers are younger than the watermark
    later = spark.createDataFrame([(3, 1_700_090_000, 9000, "soft")], "mover long, s long, event_id long, band string").select("mover", F.timestamp_seconds("s").alias("ts"), "event_id", "band")
    deliver(later)
    want, last = [], {}
    for r in sorted(seen.collect(), key=lambda r: (r["ts"], r["event_id"])):
        if r["mover"] in last and last[r["mover"]] != r["band"]:
            want.append((r["mover"], r["event_id"], last[r["mover"]], r["band"]))
        last[r["mover"]] = r["band"]
    assert sorted(map(str, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))) == sorted(map(str, want)) and len(want) > 2000


def test_rings_share_groups(spark, monkeypatch):
    """Many rings are worked on in few groups, each as by itself, whatever the order of its rows."""
    from tessera.operators import zones

    monkeypatch.setattr(zones, "GROUPS_PER_TASK", 1)
    rows = [(z, k, float((k * 7 + z) % 11), float((k * 5 + z * 3) % 13)) for z in range(200) for k in (3, 0, 5, 1, 4, 2)]
    vertices = spark.createDataFrame(rows, "zone_id int, seq int, lon double, lat double")
    out = zones.simplify_to(vertices, 4)
    assert "group_" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r["zone_id"], []).append((r["seq"], r["lat"], r["lon"]))
    for z in range(200):
        points = [(lat, lon) for k, lon, lat in sorted(r[1:] for r in rows if r[0] == z)]
        fewest = next(zones.reduce_line(points, e / 1000) for e in range(1, 100_000) if len(zones.reduce_line(points, e / 1000)) <= 4)
        want = [(round(a), round(b)) for a, b in fewest]
        assert [p[1:] for p in sorted(got[z])] == (want[:-1] if want[0] == want[-1] else want)


def test_sources_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Rows are dealt by their number, not by their compressed size, which is next to nothing here; the first source counts."""
    from tessera.operators import lineage, osm

    monkeypatch.setattr(lineage, "TASK_ROWS", 500)
    rows = spark.range(6000).select((F.col("id") % 3000).alias("id"), F.when(F.col("id") < 3000, "b").otherwise("a").alias("source")).where("source = 'b' or id % 2 = 0")
    first = osm.first_source(rows, "id").cache()
    sizes = [r["n"] for r in first.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 8 and max(sizes) <= 500
    assert first.where("source = 'a'").count() == first.where("id % 2 = 0").count() == 1500


def test_elements_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    """The same elements whatever the number of rows that a task is dealt."""
    from tessera.operators import lineage, osm

    nodes = spark.range(400).select("id", (F.col("id") % 5).cast("int").alias("x"), (F.col("id") % 3).cast("int").alias("y"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    refs = spark.range(900).select((F.col("id") % 300).alias("way_id"), F.floor(F.col("id") / 300).cast("int").alias("seq"), (F.col("id") * 7 % 400).alias("ref"))
    members = spark.range(200).select((F.col("id") % 50).alias("rel_id"), F.when(F.col("id") % 4 == 0, "node").otherwise("way").alias("member_type"), F.col("id").alias("ref"), F.lit("").alias("role"))
    targets = nodes.select("x", "y").distinct().where("(x + y) % 2 = 0")
    found = lambda: osm.elements(nodes, refs, members, targets)
    whole = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(lineage, "TASK_ROWS", 50)
    few = found()
    assert sorted(map(tuple, few.collect())) == whole and {r[2] for r in whole} == {"node", "foreign", "way", "relation"}
    assert few._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3
