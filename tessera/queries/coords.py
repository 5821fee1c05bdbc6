"""Queries of coordinate functions and row generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.functions import geo
from tessera.operators import generate as g
from tessera.operators import plan

OLAT, OLON, SCALE = 45.0, 25.0, 0.3
M = "111320.0"
MPD = "(111320.0 * cos(radians(45.0)))"


def r(c, n=6):
    return F.round(c, n)


def block_of_point(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "fx_point")
    return p.select(
        "point_id",
        geo.block_x("lon", OLAT, OLON, SCALE).alias("bx"),
        geo.block_z("lat", OLAT, SCALE).alias("bz"),
        r(geo.metres_per_lon("lat")).alias("mpd"),
    )


def block_round_trip(spark, d):
    p = view(spark, d, "fx_point")
    f = p.withColumn("x", geo.block_xf("lon", OLAT, OLON, SCALE)).withColumn("z", geo.block_zf("lat", OLAT, SCALE))
    return f.select(
        "point_id", r("x", 4).alias("x"), r("z", 4).alias("z"),
        r(geo.lon_of_block("x", OLAT, OLON, SCALE)).alias("lon"), r(geo.lat_of_block("z", OLAT, SCALE)).alias("lat"),
    )


def region_of_point(spark, d):
    p = view(spark, d, "fx_point")
    x, z = geo.block_xf("lon", OLAT, OLON, SCALE), geo.block_zf("lat", OLAT, SCALE)
    return p.select(
        "point_id", geo.region_of(F.floor(x)).alias("reg_x"), geo.region_of(F.floor(z)).alias("reg_z"),
        geo.corner_region(x).alias("corner_x"), geo.corner_region(z).alias("corner_z"),
    )


def tile_of_point(spark, d):
    p = view(spark, d, "fx_point")
    return p.select("point_id", geo.tile_x("lon", 11).alias("x"), geo.tile_y("lat", 11).alias("y"), geo.tile_x("lon", 15).alias("x15"))


def tile_bounds(spark, d):
    t = view(spark, d, "fx_node_tile").select("x", "y").distinct()
    return t.select("x", "y", *[r(c).alias(s) for s, c in geo.tile_bbox("x", "y", 11).items()])


def cell_keys(spark, d):
    c = view(spark, d, "fx_cell_event").select("cell_key").distinct()
    off = geo.key_offset("cell_key")
    own = geo.owned_rectangle(geo.key_part("cell_key", 0), geo.key_part("cell_key", 1), geo.key_part("cell_key", 2))
    return c.select(
        "cell_key", off["rx"].alias("off_x"), off["rz"].alias("off_z"), geo.valid_key("cell_key").alias("valid"),
        *[v.alias(k) for k, v in own.items()],
    )


def cell_bbox(spark, d):
    p = view(spark, d, "fx_plan")
    return p.select("cell_key", *[r(c, 8).alias(s) for s, c in geo.cell_bbox("rx", "rz", "size", OLAT, OLON, SCALE).items()])


def snap_region(spark, d):
    p = view(spark, d, "fx_point")
    s = geo.snap_region("lat", "lon", SCALE)
    t = geo.snap_region("lat", "lon", SCALE, OLAT, OLON)
    return p.select("point_id", r(s["lat"]).alias("lat"), r(s["lon"]).alias("lon"), r(t["lat"]).alias("lat_a"), r(t["lon"]).alias("lon_a"))


def _point_boxes(spark, d):
    p = view(spark, d, "fx_point")
    return p.select("point_id", (F.col("lat") - 0.0213).alias("south"), (F.col("lon") - 0.0317).alias("west"), (F.col("lat") + 0.0171).alias("north"), (F.col("lon") + 0.0229).alias("east"))


def snap_bbox(spark, d):
    b = _point_boxes(spark, d)
    out = geo.snap_bbox(g.box(b), OLAT, OLON, SCALE)
    return b.select("point_id", *[r(c).alias(s) for s, c in out.items()])


def expand_bbox(spark, d):
    b = _point_boxes(spark, d)
    seam = geo.expand_bbox(g.box(b), 2, OLAT, OLON, SCALE)
    lat, lon = geo.margin_degrees(500.0, (F.col("south") + F.col("north")) / 2)
    pad = geo.grow_bbox(seam, lat, lon)
    return b.select("point_id", *[r(c).alias(s) for s, c in seam.items()], r(pad["south"]).alias("pad_south"), r(pad["east"]).alias("pad_east"))


def generation_bbox(spark, d):
    b = _point_boxes(spark, d)
    return b.select("point_id", *[r(c).alias(s) for s, c in geo.generation_bbox(g.box(b), SCALE).items()])


def boxes_in_sql(spark, d):
    """Tiles and cells of each box by the SQL table functions."""
    g.register_table_functions(spark)
    _point_boxes(spark, d).createOrReplaceTempView("tessera_boxes")
    tiles = spark.sql("SELECT b.point_id, 'tile' AS kind, CAST(t.x AS BIGINT) AS a, CAST(t.y AS BIGINT) AS b FROM tessera_boxes b, LATERAL tiles_for_box(b.south, b.west, b.north, b.east, 13) t")
    cells = spark.sql(f"SELECT b.point_id, 'cell' AS kind, c.rx AS a, c.rz AS b FROM tessera_boxes b, LATERAL cells_for_box(b.south, b.west, b.north, b.east, {OLAT}D, {OLON}D, {SCALE}D, 4) c")
    return tiles.unionByName(cells)


def bbox_area(spark, d):
    b = _point_boxes(spark, d)
    lat, lon = geo.margin_degrees(1000.0, "south")
    return b.select("point_id", r(geo.area_km2(g.box(b)), 4).alias("km2"), r(lat, 8).alias("margin_lat"), r(lon, 8).alias("margin_lon"))


def recommended_zoom(spark, d):
    p = view(spark, d, "fx_point")
    scale = (F.col("point_id") % 50 + 1) / F.lit(50.0)
    return p.select("point_id", geo.recommended_zoom(scale, "lat").alias("zoom"))


def bbox_keys(spark, d):
    b = _point_boxes(spark, d)
    return b.select("point_id", geo.bbox_key(g.box(b), "v1").alias("bbox_key"), geo.region_id(g.box(b), F.lit(" Area ")).alias("region_id"), geo.tile_name(F.lit(11), geo.tile_x("west", 11), geo.tile_y("south", 11)).alias("tile_name"))


def plan_size(spark, d):
    return plan.size_estimate(view(spark, d, "fx_plan"), "status")


def realm_of_point(spark, d):
    p = view(spark, d, "fx_point")
    lat, lon = F.col("lat") * 3 - 100, F.col("lon") * 20 - 330
    return p.select("point_id", geo.realm_of(lat, lon).alias("realm"))


def cells_for_bbox(spark, d):
    b = _point_boxes(spark, d)
    return g.cells_for_bbox(b, OLAT, OLON, SCALE, 4).select("point_id", F.col("rx").cast("int"), F.col("rz").cast("int"), "cell_key")


def tiles_for_bbox(spark, d):
    return g.tiles_for_bbox(_point_boxes(spark, d), 13).select("point_id", "z", "x", "y")


def regions_of_cell(spark, d):
    return g.regions_of(view(spark, d, "fx_plan")).select("cell_key", "reg_x", "reg_z")


def split_bbox(spark, d):
    b = _point_boxes(spark, d).withColumn("north", F.col("south") + 0.5).withColumn("east", F.col("west") + 0.3)
    return g.split_bbox(b).select("point_id", "part", *[r(f"sub_{s}").alias(s) for s in g.SIDES])


def tile_ancestors(spark, d):
    return g.ancestors(view(spark, d, "fx_tile_level").where("z = 13")).select("z", "x", "y", "zp", "xp", "yp")


def cell_neighbours(spark, d):
    p = view(spark, d, "fx_plan")
    return g.neighbours(p).select("cell_key", "n_rx", "n_rz", F.lit(8).alias("ways")).unionByName(
        g.neighbours(p, diagonal=False).select("cell_key", "n_rx", "n_rz", F.lit(4).alias("ways"))
    )


def ring_edges(spark, d):
    return g.edges(view(spark, d, "fx_zone_vertex"), "zone_id").select("zone_id", "seq", "lon", "lat", "lon2", "lat2")


QUERIES = {
    f.__name__: f
    for f in (
        block_of_point, block_round_trip, region_of_point, tile_of_point, tile_bounds, cell_keys, cell_bbox, snap_region, snap_bbox,
        expand_bbox, generation_bbox, boxes_in_sql, bbox_area, recommended_zoom, bbox_keys, plan_size, realm_of_point, cells_for_bbox, tiles_for_bbox,
        regions_of_cell, split_bbox, tile_ancestors, cell_neighbours, ring_edges,
    )
}

BOXES = "(SELECT point_id, lat - 0.0213 AS south, lon - 0.0317 AS west, lat + 0.0171 AS north, lon + 0.0229 AS east FROM fx_point)"
X, Z = f"((lon - 25.0) * {MPD} * 0.3)", f"((45.0 - lat) * {M} * 0.3)"
LAT_STEP, LON_STEP = f"(1.0 / CAST(0.3 AS DOUBLE) / {M})", f"(1.0 / CAST(0.3 AS DOUBLE) / {MPD})"


def _tx(lon, z):
    return f"CAST(greatest(0, least({(1 << z) - 1}, floor(({lon} + 180.0) / 360.0 * {1 << z}))) AS INT)"


def _ty(lat, z):
    return f"CAST(greatest(0, least({(1 << z) - 1}, floor((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * {1 << z}))) AS INT)"


def _snap(v, zero, step):
    return f"({zero} + round_even(({v} - {zero}) / {step}, 0) * {step})"


def _sides(snap_lat, snap_lon):
    return {"south": snap_lat("south"), "west": snap_lon("west"), "north": snap_lat("north"), "east": snap_lon("east")}


def _step_region(anchor):
    lat_q = "(CAST(512.0 AS DOUBLE) / 111320.0 / CAST(0.3 AS DOUBLE))"
    lat = f"({anchor[0]} + round_even((lat - {anchor[0]}) / {lat_q}, 0) * {lat_q})"
    ref = f"{anchor[0]}" if anchor[0] != "CAST(0.0 AS DOUBLE)" else lat
    lon_q = f"(CAST(512.0 AS DOUBLE) / CAST(0.3 AS DOUBLE) / (111320.0 * cos(radians({ref}))))"
    return lat, f"({anchor[1]} + round_even((lon - {anchor[1]}) / {lon_q}, 0) * {lon_q})"


_S0, _S1 = _step_region(("CAST(0.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)")), _step_region(("CAST(45.0 AS DOUBLE)", "CAST(25.0 AS DOUBLE)"))
_SNAP = _sides(lambda v: _snap(v, "CAST(45.0 AS DOUBLE)", LAT_STEP), lambda v: _snap(v, "CAST(25.0 AS DOUBLE)", LON_STEP))
_BY_LAT, _BY_LON = f"(2 * 16 / CAST(0.3 AS DOUBLE) / {M})", f"(2 * 16 / CAST(0.3 AS DOUBLE) / {MPD})"
_EXP = {
    s: _snap(f"({s} {'-' if s in ('south', 'west') else '+'} {_BY_LAT if s in ('south', 'north') else _BY_LON})", f"CAST({45.0 if s in ('south', 'north') else 25.0} AS DOUBLE)", LAT_STEP if s in ("south", "north") else LON_STEP)
    for s in ("south", "west", "north", "east")
}
_REALM = "CASE " + " ".join(
    f"WHEN lat * 3 - 100 BETWEEN {a} AND {b} AND lon * 20 - 330 BETWEEN {c} AND {e} THEN '{code}'" for code, a, b, c, e in geo.REALM_BOXES
) + f" ELSE '{geo.NO_REALM}' END"
_CELL = f"(4 * 512 / CAST(0.3 AS DOUBLE) / {M})", f"(4 * 512 / CAST(0.3 AS DOUBLE) / {MPD})"

SQL = {
    "block_of_point": f"SELECT point_id, CAST(floor{X} AS BIGINT) AS bx, CAST(floor{Z} AS BIGINT) AS bz, round({M} * cos(radians(lat)), 6) AS mpd FROM fx_point",
    "block_round_trip": f"SELECT point_id, round({X}, 4) AS x, round({Z}, 4) AS z, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_point",
    "region_of_point": f"SELECT point_id, CAST(floor(floor{X} / 512.0) AS BIGINT) AS reg_x, CAST(floor(floor{Z} / 512.0) AS BIGINT) AS reg_z, CAST(floor(floor({X} + 1e-6) / 512.0) AS BIGINT) AS corner_x, CAST(floor(floor({Z} + 1e-6) / 512.0) AS BIGINT) AS corner_z FROM fx_point",
    "tile_of_point": f"SELECT point_id, {_tx('lon', 11)} AS x, {_ty('lat', 11)} AS y, {_tx('lon', 15)} AS x15 FROM fx_point",
    "tile_bounds": "SELECT DISTINCT x, y, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 2048.0)))), 6) AS south, round(x / 2048.0 * 360.0 - 180.0, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 2048.0)))), 6) AS north, round((x + 1) / 2048.0 * 360.0 - 180.0, 6) AS east FROM fx_node_tile",
    "cell_keys": "SELECT cell_key, a * s AS off_x, -b * s AS off_z, s BETWEEN 1 AND 16 AS valid, a * s AS rx_min, a * s + s - 1 AS rx_max, -b * s - s AS rz_min, -b * s - 1 AS rz_max FROM (SELECT DISTINCT cell_key, CAST(split_part(cell_key, ',', 1) AS INT) AS a, CAST(split_part(cell_key, ',', 2) AS INT) AS b, CAST(split_part(cell_key, ',', 3) AS INT) AS s FROM fx_cell_event) t",
    "cell_bbox": f"SELECT cell_key, round(45.0 + rz * {_CELL[0]}, 8) AS south, round(25.0 + rx * {_CELL[1]}, 8) AS west, round(45.0 + rz * {_CELL[0]} + {_CELL[0]}, 8) AS north, round(25.0 + rx * {_CELL[1]} + {_CELL[1]}, 8) AS east FROM fx_plan",
    "snap_region": f"SELECT point_id, round({_S0[0]}, 6) AS lat, round({_S0[1]}, 6) AS lon, round({_S1[0]}, 6) AS lat_a, round({_S1[1]}, 6) AS lon_a FROM fx_point",
    "snap_bbox": "SELECT point_id, " + ", ".join(f"round({c}, 6) AS {s}" for s, c in _SNAP.items()) + f" FROM {BOXES} b",
    "expand_bbox": "SELECT point_id, " + ", ".join(f"round({c}, 6) AS {s}" for s, c in _EXP.items()) + f", round({_EXP['south']} - 500.0 / {M}, 6) AS pad_south, round({_EXP['east']} + 500.0 / ({M} * cos(radians((south + north) / 2))), 6) AS pad_east FROM {BOXES} b",
    "generation_bbox": "SELECT point_id, " + ", ".join(f"round({s} {'-' if s in ('south', 'west') else '+'} ((512 + 8 * 16) / CAST(0.3 AS DOUBLE) + 256) / {M if s in ('south', 'north') else f'({M} * cos(radians((south + north) / 2)))'}, 6) AS {s}" for s in g.SIDES) + f" FROM {BOXES} b",
    "bbox_area": f"SELECT point_id, round((north - south) * {M} * (east - west) * {M} * cos(radians((south + north) / 2)) / 1e6, 4) AS km2, round(1000.0 / {M}, 8) AS margin_lat, round(1000.0 / ({M} * cos(radians(south))), 8) AS margin_lon FROM {BOXES} b",
    "recommended_zoom": "SELECT point_id, CAST(greatest(11, least(15, round_even(15.0 - log2((1.0 / ((point_id % 50 + 1) / CAST(50.0 AS DOUBLE))) / (40075016.0 / (256.0 * 32768.0) * cos(radians(lat)))), 0))) AS INT) AS zoom FROM fx_point",
    "bbox_keys": f"SELECT point_id, substr(sha1(printf('%.7f,%.7f,%.7f,%.7f|v1', south, west, north, east)), 1, 16) AS bbox_key, substr(sha1(printf('%.4f,%.4f,%.4f,%.4f|area', south, west, north, east)), 1, 16) AS region_id, printf('osm_g1_z11_%d_%d.json', {_tx('west', 11)}, {_ty('south', 11)}) AS tile_name FROM {BOXES} b",
    "plan_size": "SELECT status, CAST(sum(size * size) AS BIGINT) AS regions, CAST(sum(size * size) * 4 AS BIGINT) AS mb FROM fx_plan GROUP BY status",
    "realm_of_point": f"SELECT point_id, {_REALM} AS realm FROM fx_point",
    "cells_for_bbox": f"SELECT point_id, CAST(rx AS INT) AS rx, CAST(rz AS INT) AS rz, concat(CAST(rx AS VARCHAR), ',', CAST(rz AS VARCHAR), ',4') AS cell_key FROM (SELECT *, unnest(range(CAST(floor((west - 25.0) / {_CELL[1]}) AS BIGINT), CAST(ceil((east - 25.0) / {_CELL[1]}) AS BIGINT))) AS rx FROM (SELECT *, unnest(range(CAST(floor((south - 45.0) / {_CELL[0]}) AS BIGINT), CAST(ceil((north - 45.0) / {_CELL[0]}) AS BIGINT))) AS rz FROM {BOXES} b) c) e WHERE 45.0 + rz * {_CELL[0]} + {_CELL[0]} > south AND 45.0 + rz * {_CELL[0]} < north AND 25.0 + rx * {_CELL[1]} + {_CELL[1]} > west AND 25.0 + rx * {_CELL[1]} < east",
    "tiles_for_bbox": f"SELECT point_id, 13 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT *, unnest(range({_ty('north', 13)}, {_ty('south', 13)} + 1)) AS y FROM (SELECT *, unnest(range({_tx('west', 13)}, {_tx('east', 13)} + 1)) AS x FROM {BOXES} b) c) e",
    "regions_of_cell": "SELECT cell_key, CAST(reg_x AS INT) AS reg_x, CAST(reg_z AS INT) AS reg_z FROM (SELECT *, unnest(range(-rz * size - size, -rz * size)) AS reg_z FROM (SELECT *, unnest(range(rx * size, rx * size + size)) AS reg_x FROM fx_plan) a) b",
    "split_bbox": "SELECT point_id, part, round(south + floor(part / cols) * la, 6) AS south, round(west + (part % cols) * lo, 6) AS west, round(least(north, south + floor(part / cols) * la + la), 6) AS north, round(least(east, west + (part % cols) * lo + lo), 6) AS east FROM (SELECT *, unnest(range(CAST(least(512, rows_ * cols) AS BIGINT))) AS part FROM (SELECT *, greatest(1, ceil((north - south) / la - 1e-9)) AS rows_, CAST(greatest(1, ceil((east - west) / lo - 1e-9)) AS BIGINT) AS cols FROM (SELECT point_id, south, west, south + 0.5 AS north, west + 0.3 AS east, greatest(CAST(0.04 AS DOUBLE), sqrt((south + 0.5 - south) * (west + 0.3 - west) / 96)) AS la, greatest(CAST(0.04 AS DOUBLE), sqrt((south + 0.5 - south) * (west + 0.3 - west) / 96)) AS lo FROM " + BOXES + " b) c) e) f",
    "tile_ancestors": "SELECT z, x, y, CAST(zp AS INT) AS zp, x >> CAST(z - zp AS INT) AS xp, y >> CAST(z - zp AS INT) AS yp FROM (SELECT z, x, y, unnest(range(11, z)) AS zp FROM fx_tile_level WHERE z = 13) t",
    "cell_neighbours": "SELECT cell_key, rx + dx AS n_rx, rz + dz AS n_rz, w AS ways FROM fx_plan CROSS JOIN (VALUES (-1), (0), (1)) a(dx) CROSS JOIN (VALUES (-1), (0), (1)) b(dz) CROSS JOIN (VALUES (8), (4)) c(w) WHERE (dx <> 0 OR dz <> 0) AND (w = 8 OR dx * dz = 0)",
    "ring_edges": "SELECT a.zone_id, a.seq, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2 FROM fx_zone_vertex a JOIN fx_zone_vertex b ON a.zone_id = b.zone_id AND b.seq = (a.seq + 1) % 6",
}
SQL["boxes_in_sql"] = f"SELECT point_id, 'tile' AS kind, CAST(x AS BIGINT) AS a, CAST(y AS BIGINT) AS b FROM ({SQL['tiles_for_bbox']}) t UNION ALL SELECT point_id, 'cell', CAST(rx AS BIGINT), CAST(rz AS BIGINT) FROM ({SQL['cells_for_bbox']}) c"
