"""Coordinate facts, and invariants of the geodata operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import generate, merge, ordering, osm, plan, raster, runs, zones
from tessera.fixtures import view
from tessera.operators.ordering import global_rank
from tessera.plans import pipelines

ORIGIN = (46.0, 25.0)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_reference_values(spark):
    lat, lon = geo.cell_degrees(4, 46.0, 0.3)
    row = one(spark, geo.metres_per_lon(46.0), lat, lon)
    assert round(row[0]) == 77329 and abs(row[1] - 0.06133) < 1e-5 and abs(row[2] - 0.08828) < 1e-4


def test_cell_keys(spark):
    rows = spark.createDataFrame([("10,0,4",), ("10,3,4",), ("11,0,4",), ("bad",), ("1,2",), (None,), ("a,b,c",), ("1,2,99",)], "k string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("k", geo.key_offset("k"), geo.valid_key("k")).collect()}
    assert tuple(got["10,0,4"][0]) == (40, 0) and tuple(got["10,3,4"][0]) == (40, -12)
    assert got["bad"][0] == (None, None) and [k for k, v in got.items() if v[1]] == ["10,0,4", "10,3,4", "11,0,4"]


def test_neighbour_rectangles_abut(spark):
    a = one(spark, *geo.owned_rectangle(F.lit(10), F.lit(0), F.lit(4)).values())
    b = one(spark, *geo.owned_rectangle(F.lit(11), F.lit(0), F.lit(4)).values())
    assert tuple(a) == (40, 43, -4, -1) and b[0] == a[1] + 1


def test_nine_cells_for_two_and_a_half(spark):
    d_lat, d_lon = (512 * 4 / 0.3 / 111320.0), 512 * 4 / 0.3 / (111320.0 * math.cos(math.radians(46.0)))
    box = spark.createDataFrame([(46.0, 25.0, 46.0 + 2.5 * d_lat, 25.0 + 2.5 * d_lon)], "south double, west double, north double, east double")
    assert generate.cells_for_bbox(box, *ORIGIN, 0.3, 4).count() == 9


def test_snap_is_idempotent(spark):
    s = geo.snap_region(46.123, 25.456, 0.3)
    first = one(spark, s["lat"], s["lon"])
    t = geo.snap_region(first[0], first[1], 0.3)
    again = one(spark, t["lat"], t["lon"])
    assert abs(first[0] - again[0]) < 1e-9 and abs(first[1] - again[1]) < 1e-9


def test_corners_agree_with_keys(spark):
    for olon in (7.0, 25.0, -3.5, 139.7):
        cells = spark.range(13).select((F.col("id") - 6).alias("rx")).crossJoin(spark.range(13).select((F.col("id") - 6).alias("rz")))
        box = geo.cell_bbox("rx", "rz", 4, 46.0, olon, 0.3)
        off = cells.select(
            "rx", "rz",
            geo.corner_region(geo.block_xf(box["west"], 46.0, olon, 0.3)).alias("x"), geo.corner_region(geo.block_zf(box["south"], 46.0, 0.3)).alias("z"),
        )
        assert off.where("x <> rx * 4 or z <> -rz * 4").count() == 0


def test_grow_equals_single_rounds(spark, sf_dir):
    p = view(spark, sf_dir, "fx_plan").select(*plan.PLAN).where("rx % 5 = 0")
    for n in (1, 2, 3):
        for diagonal in (True, False):
            step = p
            for _ in range(n):
                step = plan.grow(step, 1, diagonal)
            assert sorted(r["cell_key"] for r in step.collect()) == sorted(r["cell_key"] for r in plan.grow(p, n, diagonal).collect())


def test_baked_ways_are_complete(spark, sf_dir):
    nodes, refs = view(spark, sf_dir, "fx_node_tile"), view(spark, sf_dir, "fx_way_ref")
    located = osm.way_locations(refs, nodes)
    emitted = osm.way_tiles(located)
    have = osm.foreign_nodes(located, emitted).select("x", "y", "ref").unionByName(nodes.select("x", "y", F.col("id").alias("ref")))
    need = emitted.join(located.where("x is not null").select("way_id", "ref"), "way_id").select("x", "y", "ref")
    assert need.join(have, ["x", "y", "ref"], "left_anti").count() == 0


def test_owner_follows_from_region(spark, sf_dir):
    p = view(spark, sf_dir, "fx_plan")
    wrong = merge.owner_of(generate.regions_of(p), 4).where("owner_key <> cell_key")
    assert wrong.count() == 0


def test_repair_leaves_no_fixable_hole(spark, sf_dir):
    from tessera.queries import rasters

    tiles, parents = rasters._tiles(spark, sf_dir), rasters._parent_tiles(spark, sf_dir)
    fixed = raster.repair(tiles, parents, 8)
    assert raster.deepest_parent(fixed.where(raster.is_hole("h", 8)), parents).count() == 0
    assert fixed.count() == tiles.count() and fixed.where("outcome = 'fixed'").count() > 0


def test_reduce_line():
    points = [(0.0, 0.0), (0.0, 1.0), (0.01, 2.0), (0.0, 3.0), (5.0, 3.0)]
    assert zones.reduce_line(points, 0.1) == [(0.0, 0.0), (0.0, 3.0), (5.0, 3.0)]
    assert zones.reduce_line(points, 0.001) == [(0.0, 0.0), (0.0, 1.0), (0.01, 2.0), (0.0, 3.0), (5.0, 3.0)]
    circle = [(1000 * math.cos(k / 50), 1000 * math.sin(k / 50)) for k in range(315)]
    assert 8 <= len(zones.reduce_to(circle, 20)) <= 20


def test_simplify_keeps_short_rings(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 0.0, 1.0)], "zone_id int, seq int, lon double, lat double")
    assert zones.simplify(v, 10.0).count() == 3


def test_groups_stay_in_budget(spark, sf_dir):
    from tessera.operators import coverage

    cells = view(spark, sf_dir, "fx_cell_box")
    grouped = coverage.plan_groups(cells, 500.0)
    assert grouped.count() == cells.count()
    boxes = coverage.union_bbox(grouped, "grp").withColumn("km2", geo.area_km2({s: F.col(s) for s in generate.SIDES}))
    sizes = grouped.groupBy("grp").count()
    assert boxes.join(sizes, "grp").where("km2 > 500 and count > 1 and length(grp) < 6").count() == 0


def test_param_drift(spark):
    meta = spark.createDataFrame([("a", 0.3, 46.0, 25.0, 1), ("b", 0.30001, 46.0, 25.0, 1), ("c", 0.3, 46.0, 25.1, 0)], "world string, scale double, lat double, lon double, merged int")
    assert {r["world"]: r["drift"] for r in plan.param_drift(meta, 0.3, 46.0, 25.0).collect()} == {"a": False, "b": True, "c": False}


def test_global_rank(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    ranked = global_rank(df, "place", "b", "a").collect()
    want = sorted((r["b"], r["a"]) for r in ranked)
    assert [(r["b"], r["a"]) for r in sorted(ranked, key=lambda r: r["place"])] == want and sorted(r["place"] for r in ranked) == list(range(1, 5001))
    assert global_rank(df.limit(0), "place", "a").count() == 0


def test_zone_without_country(spark):
    spec = spark.createDataFrame([("z", ["Nowhere"])], "zone string, names array<string>")
    with pytest.raises(ValueError):
        zones.zone_members(spec, spark.createDataFrame([("A", 1)], "name string, country_id int"))


def test_systematic(spark):
    df = spark.range(1, 101).select(F.col("id").alias("k"))
    assert [r["k"] for r in runs.systematic(df, 10, "k").orderBy("k").collect()] == [1 + i * 10 for i in range(10)]


def test_pipelines(spark, sf_dir, tmp_path):
    nodes = view(spark, sf_dir, "fx_node")
    targets = view(spark, sf_dir, "fx_node_tile").select("x", "y").distinct()
    found, counts = pipelines.bake(nodes, view(spark, sf_dir, "fx_way_ref"), view(spark, sf_dir, "fx_rel_member"), targets)
    assert counts.count() == targets.count() and found.where("kind = 'node'").count() == nodes.count()
    p = view(spark, sf_dir, "fx_plan").select(*plan.PLAN)
    chosen = pipelines.plan_selection(p, view(spark, sf_dir, "fx_zone_vertex"), 45.0, 25.0, 0.3, 16)
    assert chosen.count() > p.count()
    assert pipelines.plan_selection(chosen, view(spark, sf_dir, "fx_zone_vertex"), 45.0, 25.0, 0.3, 16, removing=True).count() <= p.count()
    packs = pipelines.pack_status(spark.createDataFrame([("A", 45.0, 25.0, 45.1, 25.1)], "name string, south double, west double, north double, east double"), view(spark, sf_dir, "fx_cached_tile"), 0.3)
    pipelines.write_packs(packs, str(tmp_path / "packs"))
    assert spark.read.json(str(tmp_path / "packs")).first()["elevation"]["total"] == packs.first()["total"]
    outline, _ = pipelines.zone_outlines(spark.createDataFrame([("z", ["ZONE1"])], "zone string, names array<string>"), spark.createDataFrame([("zone1", 1)], "name string, country_id int"), view(spark, sf_dir, "fx_zone_vertex"), 45.0, 25.0, 0.3, 4)
    assert 3 <= outline.count() <= 4


def test_repeated_points_count_once_each(spark):
    square = [(1, k, lon, lat) for k, (lon, lat) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    rings = spark.createDataFrame(square + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0)], "zone_id int, seq int, lon double, lat double")
    points = spark.createDataFrame([(0.5, 0.5)] * 3 + [(0.5, 1.5), (-0.1, 0.5)], "lat double, lon double")
    assert [tuple(r) for r in zones.points_in_zones(points, rings).collect()] == [(0.5, 0.5, 1)] * 3


def test_ewma_is_exact(spark):
    events = spark.createDataFrame([(k % 2, k, k, float(k % 7 + 1)) for k in range(200)], "worker int, ts int, event_id int, duration_s double")
    for worker, got in ((r["worker"], r["ewma"]) for r in runs.ewma(events, "worker").collect()):
        mean = None
        for k in range(worker, 200, 2):
            mean = k % 7 + 1 if mean is None else 0.3 * (k % 7 + 1) + 0.7 * mean
        assert abs(got - mean) < 1e-9


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def geo_queries():
    from tessera.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", geo_queries())
def test_query_equals_its_sql(spark, sf_dir, name):
    from tessera.queries import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, sf_dir)
    cursor = duck(sf_dir).execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(tuple(r[columns.index(c)] for c in df.columns)) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


def test_simplified_to_few_points(spark, sf_dir):
    """The one query without SQL: rings of six points in whole numbers, at most four of them, against a search in plain Python."""
    from tessera.queries import QUERIES

    got = {}
    for r in QUERIES["simplify_to"](spark, sf_dir).collect():
        got.setdefault(r["zone_id"], []).append((r["lat"], r["lon"]))
    rings = {}
    for r in view(spark, sf_dir, "fx_zone_vertex").orderBy("seq").collect():
        rings.setdefault(r["zone_id"], []).append((r["lat"] * 1000, r["lon"] * 1000))
    assert set(got) == set(rings)
    for zone, points in rings.items():
        fewest = next(zones.reduce_line(points, eps / 100) for eps in range(100_000) if len(zones.reduce_line(points, eps / 100)) <= 4)
        assert got[zone] == [(float(round(a)), float(round(b))) for a, b in fewest]


def test_country_sized_rings(spark):
    """A coast of 100,000 vertices and its islands: points as by ray casting in numpy, distances as by brute force, rows about as many as vertices."""
    rng = np.random.default_rng(11)
    n = 100_000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    rough = sum(np.sin(k * angle + rng.uniform(0, 6)) / k**1.1 for k in rng.integers(2, 4000, 60))
    radius = 4 + 0.3 * rough + 0.0005 * rng.standard_normal(n)
    ring = np.stack((10 + radius * np.cos(angle), 47 + 0.7 * radius * np.sin(angle)), 1)
    square = np.array([(13.0, 47.0), (15.0, 47.0), (15.0, 49.0), (13.0, 49.0)])  # vertices on round numbers, overlapping
    shapes = {1: ring, 2: square, 3: square[:2]}
    vertices = spark.createDataFrame(pd.concat([pd.DataFrame({"zone_id": z, "seq": range(len(s)), "lon": s[:, 0], "lat": s[:, 1]}) for z, s in shapes.items()]))
    edged, inner = zones.ring_cover(vertices)
    assert edged.count() + inner.count() < 4 * n
    at = np.concatenate((rng.uniform((4, 42.5), (16, 51.5), (300, 2)), ring[rng.integers(0, n, 300)] + 0.002 * rng.standard_normal((300, 2)), [(13.5, 48.0), (13.0, 48.5), (14.0, 47.0)]))
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(len(at)), "lat": at[:, 1], "lon": at[:, 0]}))
    got = {(r["point_id"], r["zone_id"]) for r in zones.points_in_zones(points, vertices).collect()}
    want = set()
    for z in (1, 2):
        (x1, y1), (x2, y2) = np.roll(shapes[z], -1, 0).T, shapes[z].T
        for k, (lon, lat) in enumerate(at):
            spans = (y1 > lat) != (y2 > lat)
            with np.errstate(all="ignore"):
                if np.count_nonzero(spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1 + 1e-18) + x1)) % 2:
                    want.add((k, z))
    assert got == want and len({k for k, z in want if z == 1}) > 200
    some = points.where("point_id % 5 = 0").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("z"))
    segments = vertices.where("zone_id < 3")
    lines = generate.edges(segments, "zone_id").select("zone_id", F.col("lon").alias("x1"), F.col("lat").alias("z1"), F.col("lon2").alias("x2"), F.col("lat2").alias("z2"))
    found = {r["point_id"]: r["distance"] for r in zones.nearest(some.select("point_id", (F.col("x") * 1000).alias("x"), (F.col("z") * 1000).alias("z")), lines.select("zone_id", *[(F.col(c) * 1000).alias(c) for c in ("x1", "z1", "x2", "z2")]), 600.0).collect()}
    for k in range(0, len(at), 5):
        best = np.inf
        for z in (1, 2):
            a, b = 1000 * shapes[z], 1000 * np.roll(shapes[z], -1, 0)
            d, p = b - a, 1000 * at[k]
            t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
            best = min(best, np.hypot(*(p - a - t[:, None] * d).T).min())
        assert (abs(found[k] - best) < 1e-6) if best < 599.9 else best <= 600.1 or k not in found


def test_global_rank_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 5000)
    df = spark.range(120_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.col("id").alias("b"))
    ranked = global_rank(df, "place", "a", "b").toPandas().sort_values("place")
    assert (ranked["place"].to_numpy() == np.arange(1, 120_001)).all()
    pairs = ranked[["a", "b"]].to_numpy()
    assert ((pairs[1:, 0] > pairs[:-1, 0]) | ((pairs[1:, 0] == pairs[:-1, 0]) & (pairs[1:, 1] > pairs[:-1, 1]))).all()


def test_values_by_place(spark):
    rng = np.random.default_rng(1)
    for values in (rng.standard_normal(20_000) * 1e3, np.exp(rng.standard_normal(20_000) * 40), np.repeat([1.5, 2.0, 7.0], 4000), np.r_[-1.7e308, rng.uniform(0, 1, 9000), 1.7e308]):
        df = spark.createDataFrame(pd.DataFrame({"v": values})).unionByName(spark.createDataFrame([(None,)], "v double"))
        for place in (0, len(values) // 2, len(values) - 1):
            assert ordering.nth_value(df, "v", place) == np.sort(values)[place]
        assert ordering.nth_value(df, "v", len(values)) is None
    assert ordering.nth_value(df.limit(0), "v", 0) is None


def test_pixels_are_made_once(spark, sf_dir):
    """No filter looks at the size of an array that is computed below it."""
    from tessera.queries import QUERIES

    for name in ("hillshade", "overzoom", "downsample"):
        plan_ = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "size(transform" not in plan_, name


def test_space_filling_curve(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (2047, 1023), (2**30, 2**30 + 5), (123456, 654321)]
    got = spark.createDataFrame(pairs, "x int, y int").select("x", "y", geo.z_order("x", "y").alias("k")).collect()
    assert all(r["k"] == geo.z_order_of(r["x"], r["y"]) for r in got)
    assert [geo.z_order_of(x, y) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0))] == [0, 1, 2, 3, 4]
