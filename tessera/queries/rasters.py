"""Queries of elevation rasters and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.functions import geo
from tessera.operators import raster as ra
from tessera.operators import zones as zo

OLAT, OLON, SCALE, W = 45.0, 25.0, 0.3, 8


def _tiles(spark, d):
    h = F.transform("embedding", lambda e: F.when(F.col("is_hole"), -32768.0).otherwise(F.round(e.cast("double") * 1000, 3)))
    return view(spark, d, "fx_raster").select("vec_id", "z", "x", "y", h.alias("h"))


def elev_survey(spark, d):
    return ra.survey(_tiles(spark, d), W, 2)


def tile_info(spark, d):
    return ra.tile_info(_tiles(spark, d), W, 2)


def tile_range(spark, d):
    return ra.tile_range(_tiles(spark, d))


def is_hole(spark, d):
    return _tiles(spark, d).select("vec_id", ra.is_hole("h", W, 4).alias("hole"))


def _parents(spark, d):
    return view(spark, d, "fx_tile_level").where("z < 13 and has_data")


def _holes(spark, d):
    return view(spark, d, "fx_raster").where("is_hole")


def deepest_parent(spark, d):
    return ra.deepest_parent(_holes(spark, d), _parents(spark, d))


def _parent_tiles(spark, d):
    """Whole tiles of the levels above, from the view of their pixels."""
    p = view(spark, d, "fx_parent_pixel").groupBy("z", "x", "y").agg(F.sort_array(F.collect_list(F.struct("py", "px", "h"))).alias("s"))
    return p.select("z", "x", "y", F.transform("s", lambda v: v["h"]).alias("h"))


def overzoom(spark, d):
    out = ra.pixels(ra.overzoom(deepest_parent(spark, d), _parent_tiles(spark, d), W), W)
    return out.withColumn("h", F.round(F.col("h") + 1e-7, 3))  # no ties to round


def _repaired(spark, d):
    """Files of three lengths: too short, uniform, too large to be a hole."""
    length = F.when(F.col("vec_id") % 13 == 0, 60).when(F.col("vec_id") % 21 == 0, 5000).otherwise(700)
    return ra.repair(_tiles(spark, d).withColumn("length", length), _parent_tiles(spark, d), W)


def repair_tiles(spark, d):
    return _repaired(spark, d).select("z", "x", "y", "outcome")


def repair_counts(spark, d):
    return ra.repair_counts(_repaired(spark, d), "z")


def repair_pixels(spark, d):
    out = ra.pixels(ra.repair(_tiles(spark, d), _parent_tiles(spark, d), W), W)
    return out.groupBy("x", "y").agg(F.round(F.sum("h") + 1e-6, 2).alias("total"), F.count_if(F.col("h") <= ra.NO_DATA).alias("holes"))


def grey(spark, d):
    p = view(spark, d, "fx_pixel")
    return p.select("vec_id", "px", "py", F.round(ra.grey(F.col("h"), F.lit(-200.0), F.lit(300.0)), 6).alias("grey"), (F.col("h") < ra.NO_DATA).alias("mask"))


def _whole(spark, d):
    return _tiles(spark, d).where(~ra.is_hole("h", W))


def hillshade(spark, d):
    shaded = ra.hillshade(_whole(spark, d), -200.0, 300.0, W)
    return ra.pixels(shaded.withColumnRenamed("grey", "h"), W).withColumnRenamed("h", "grey")


def downsample(spark, d):
    return ra.pixels(ra.downsample(_tiles(spark, d), W), W).where("h is not null").withColumn("h", F.round("h", 6))


def pyramid(spark, d):
    out = ra.pixels(ra.pyramid(_whole(spark, d), W, 3), W).where("h is not null")
    return out.groupBy("z").agg(F.count("*").alias("pixels"), F.round(F.sum("h"), 2).alias("total"))


def encode_decode(spark, d):
    e = ra.encode(F.col("h"))
    p = view(spark, d, "fx_pixel").select("vec_id", "px", "py", *[c.cast("long").alias(k) for k, c in e.items()])
    return p.withColumn("metres", F.round(ra.decode(F.col("red"), F.col("green"), F.col("blue")), 6))


def overview(spark, d):
    p = view(spark, d, "fx_pixel").where("h > -32000").groupBy("x", "y").agg(F.avg("h").alias("mean_m"))
    return ra.overview(p, 2).select("tx", "ty", F.round("mean_m", 4).alias("mean_m"), "missing")


def points_in_zone(spark, d):
    return zo.points_in_zones(view(spark, d, "fx_point").select("point_id", "lat", "lon"), view(spark, d, "fx_zone_vertex")).select("point_id", "zone_id")


def points_in_any_zone(spark, d):
    return points_in_zone(spark, d).groupBy("point_id").agg(F.count("*").alias("zones"))


def cells_in_zone(spark, d):
    b = view(spark, d, "fx_cell_box")
    centre = b.select("cell_key", ((F.col("south") + F.col("north")) / 2).alias("lat"), ((F.col("west") + F.col("east")) / 2).alias("lon"))
    return zo.points_in_zones(centre, view(spark, d, "fx_zone_vertex")).select("cell_key").distinct()


def _bands(spark, d):
    p = view(spark, d, "fx_point").select("point_id", "lat", "lon")
    return zo.zone_band(p, view(spark, d, "fx_zone_vertex"), OLAT, OLON, SCALE, 5.0, 15.0, 5.0)


def zone_band(spark, d):
    return _bands(spark, d).select("point_id", "band")


def zone_rule(spark, d):
    return zo.zone_rule(_bands(spark, d)).select("point_id", "rule")


def shared_border(spark, d):
    return zo.shared_border(view(spark, d, "fx_zone_vertex"), OLAT, OLON, SCALE)


def largest_part(spark, d):
    v = view(spark, d, "fx_zone_vertex").withColumn("country", F.col("zone_id") % 10)
    return zo.largest_part(v, "country", "zone_id").select("country", "zone_id", F.round("area", 6).alias("area"))


def reprojected_rings(spark, d):
    v = view(spark, d, "fx_zone_vertex")
    return v.select("zone_id", "seq", F.round(geo.block_xf("lon", OLAT, OLON, SCALE), 4).alias("x"), F.round(geo.block_zf("lat", OLAT, SCALE), 4).alias("z"))


def zone_members(spark, d):
    s = view(spark, d, "supplier")
    n = view(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("country_id"))
    named = s.join(n, F.col("s_nationkey") == F.col("country_id"))
    spec = named.select(F.col("s_name").alias("zone"), F.array(F.concat(F.lit(" "), F.lower("name"), F.lit(" ")), F.lit("Nowhere"), F.col("name")).alias("names"))
    return zo.zone_members(spec, n)


def realm_join(spark, d):
    boxes = spark.createDataFrame([(c, a, b, w, e, k) for k, (c, a, b, w, e) in enumerate(geo.REALM_BOXES)], "code string, south double, north double, west double, east double, priority int")
    p = view(spark, d, "fx_point").select("point_id", (F.col("lat") * 3 - 100).alias("lat"), (F.col("lon") * 20 - 330).alias("lon"))
    return zo.realm_join(p, boxes)


def simplify_ring(spark, d):
    return zo.simplify(view(spark, d, "fx_zone_vertex"), 0.11)


def simplify_to(spark, d):
    v = view(spark, d, "fx_zone_vertex").select("zone_id", "seq", (F.col("lon") * 1000).alias("lon"), (F.col("lat") * 1000).alias("lat"))
    return zo.simplify_to(v, 4)


QUERIES = {
    f.__name__: f
    for f in (
        elev_survey, tile_info, tile_range, is_hole, deepest_parent, overzoom, repair_tiles, repair_counts, repair_pixels, grey, hillshade,
        downsample, pyramid, encode_decode, overview, points_in_zone, points_in_any_zone, cells_in_zone, zone_band, zone_rule, shared_border,
        largest_part, reprojected_rings, zone_members, realm_join, simplify_ring, simplify_to,
    )
}

_S = "(SELECT * FROM fx_pixel WHERE px % 2 = 0 AND py % 2 = 0)"
_DEEP = "(SELECT h.z, h.x, h.y, max(p.z) AS zp, h.x >> CAST(13 - max(p.z) AS INT) AS xp, h.y >> CAST(13 - max(p.z) AS INT) AS yp FROM fx_raster h JOIN fx_tile_level p ON p.z < 13 AND p.has_data AND p.x = h.x >> CAST(13 - p.z AS INT) AND p.y = h.y >> CAST(13 - p.z AS INT) WHERE h.is_hole GROUP BY h.z, h.x, h.y)"
_OZ = f"""(SELECT g.z, g.x, g.y, g.px, g.py, sum(wx * wy * p.h) AS h FROM (
 SELECT *, CASE WHEN a = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS wx, CASE WHEN b = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS wy,
 (x - xp * (8 // sub)) * sub + CASE WHEN a = 0 THEN floor(sx) ELSE least(floor(sx) + 1, sub - 1) END AS qx,
 (y - yp * (8 // sub)) * sub + CASE WHEN b = 0 THEN floor(sy) ELSE least(floor(sy) + 1, sub - 1) END AS qy FROM (
 SELECT *, greatest(0.0, least(sub - 1.0, (px + 0.5) * sub / CAST(8 AS DOUBLE) - 0.5)) AS sx, greatest(0.0, least(sub - 1.0, (py + 0.5) * sub / CAST(8 AS DOUBLE) - 0.5)) AS sy FROM (
 SELECT z, x, y, zp, xp, yp, CAST(8 >> CAST(13 - zp AS INT) AS INT) AS sub, CAST(i AS INT) AS px, CAST(j AS INT) AS py, a, b FROM {_DEEP} m
 CROSS JOIN range(8) r(i) CROSS JOIN range(8) s(j) CROSS JOIN (VALUES (0), (1)) u(a) CROSS JOIN (VALUES (0), (1)) v(b)) q) w) g
 JOIN fx_parent_pixel p ON p.z = g.zp AND p.x = g.xp AND p.y = g.yp AND p.px = g.qx AND p.py = g.qy GROUP BY ALL)"""
_OZ = _OZ.replace("GROUP BY ALL", "GROUP BY g.z, g.x, g.y, g.px, g.py")
_STATE = "CASE WHEN r.vec_id % 13 = 0 THEN 'absent' WHEN r.vec_id % 21 = 0 OR NOT r.is_hole THEN 'ok' ELSE 'hole' END"
_OUT = f"(SELECT r.z, r.x, r.y, CASE WHEN {_STATE} <> 'hole' THEN {_STATE} WHEN p.x IS NOT NULL THEN 'fixed' ELSE 'unfixable' END AS outcome FROM fx_raster r LEFT JOIN {_DEEP} p ON p.x = r.x AND p.y = r.y)"
_GREY = "greatest(0.0, least(255.0, (h - -200.0) / 500.0 * 255.0))"


def _slope(line, at):
    w = f"OVER (PARTITION BY z, x, y, {line} ORDER BY {at})"
    n = f"(CAST(lag(h) {w} IS NOT NULL AS INT) + CAST(lead(h) {w} IS NOT NULL AS INT))"
    return f"(coalesce(lead(h) {w}, h) - coalesce(lag(h) {w}, h)) / CAST({n} AS DOUBLE)"


_DOWN = "(SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y, CAST(floor((x % 2 * 8 + px) / 2.0) AS INT) AS px, CAST(floor((y % 2 * 8 + py) / 2.0) AS INT) AS py, avg(h) FILTER (h > -32000) AS h FROM {} s GROUP BY ALL)"
_P0 = "(SELECT z, x, y, px, py, h FROM fx_pixel WHERE h > -32000)"
_P1 = _DOWN.format(_P0)
_P2 = _DOWN.format(_P1)
_P3 = _DOWN.format(_P2)
_EDGE = "(SELECT a.zone_id, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2 FROM fx_zone_vertex a JOIN fx_zone_vertex b ON a.zone_id = b.zone_id AND b.seq = (a.seq + 1) % 6)"


def _inside(points, key):
    return f"(SELECT p.{key}, e.zone_id FROM {points} p JOIN {_EDGE} e ON (e.lat2 > p.lat) <> (e.lat > p.lat) AND p.lon < (e.lon - e.lon2) * (p.lat - e.lat2) / (e.lat - e.lat2 + 1e-18) + e.lon2 GROUP BY p.{key}, e.zone_id HAVING count(*) % 2 = 1)"


_IN = _inside("fx_point", "point_id")
_BX, _BZ = "({lon} - 25.0) * (111320.0 * cos(radians(45.0))) * 0.3", "(45.0 - {lat}) * 111320.0 * 0.3"
_EB = f"(SELECT zone_id, {_BX.format(lon='lon')} AS x1, {_BZ.format(lat='lat')} AS z1, {_BX.format(lon='lon2')} AS x2, {_BZ.format(lat='lat2')} AS z2 FROM {_EDGE} e)"
_T = "greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (z - z1) * (z2 - z1)) / ((x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1))))"
_DIST = f"sqrt(pow(x - x1 - {_T} * (x2 - x1), 2) + pow(z - z1 - {_T} * (z2 - z1), 2))"
_BAND = f"""(SELECT p.point_id, CASE WHEN p.point_id IN (SELECT point_id FROM {_IN} i) THEN 'inside' WHEN d <= 1500.0 THEN 'soft' WHEN d <= 4500.0 THEN 'hard' WHEN d <= 6000.0 THEN 'trim' ELSE 'outside' END AS band
 FROM fx_point p JOIN (SELECT point_id, min({_DIST}) AS d FROM (SELECT point_id, {_BX.format(lon='lon')} AS x, {_BZ.format(lat='lat')} AS z FROM fx_point) q CROSS JOIN {_EB} e GROUP BY point_id) m ON m.point_id = p.point_id)"""
_RB = "CASE " + " ".join(f"WHEN lat * 3 - 100 BETWEEN {a} AND {b} AND lon * 20 - 330 BETWEEN {c} AND {e} THEN '{k}'" for k, a, b, c, e in geo.REALM_BOXES) + f" ELSE '{geo.NO_REALM}' END"

SQL = {
    "elev_survey": f"SELECT round(min(h), 1) AS min_m, round(max(h), 1) AS max_m, count(DISTINCT vec_id) AS tiles, count(*) > 0 AS ok FROM {_S} s WHERE h BETWEEN -500 AND 9000",
    "tile_info": f"SELECT z, x, y, round(min(h), 1) AS min_m, round(max(h), 1) AS max_m, round(sum(h ORDER BY py, px) / 16, 1) AS mean_m, max(h) - min(h) < 2 AS flat FROM {_S} s GROUP BY z, x, y",
    "tile_range": "SELECT z, x, y, min(h) FILTER (h > -1000) AS lo, max(h) FILTER (h > -1000) AS hi FROM fx_pixel GROUP BY z, x, y",
    "is_hole": "SELECT vec_id, bool_and(h <= -32000) AS hole FROM fx_pixel WHERE px % 4 = 0 AND py % 4 = 0 GROUP BY vec_id",
    "deepest_parent": f"SELECT * FROM {_DEEP} d",
    "overzoom": f"SELECT z, x, y, px, py, round(h + 1e-7, 3) AS h FROM {_OZ} o",
    "repair_tiles": f"SELECT * FROM {_OUT} o",
    "repair_counts": f"SELECT z, count(*) AS checked, count(*) FILTER (outcome = 'absent') AS absent, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'fixed') AS fixed, count(*) FILTER (outcome = 'unfixable') AS unfixable FROM {_OUT} o GROUP BY z",
    "repair_pixels": f"SELECT x, y, round(sum(h) + 1e-6, 2) AS total, count(*) FILTER (h <= -32000) AS holes FROM (SELECT p.x, p.y, p.px, p.py, coalesce(o.h, p.h) AS h FROM fx_pixel p LEFT JOIN {_OZ} o ON o.x = p.x AND o.y = p.y AND o.px = p.px AND o.py = p.py) q GROUP BY x, y",
    "grey": f"SELECT vec_id, px, py, round({_GREY}, 6) AS grey, h < -32000 AS mask FROM fx_pixel",
    "hillshade": f"SELECT z, x, y, px, py, CAST(floor(greatest(0.0, least(255.0, {_GREY} * (0.5 + 0.5 * greatest(0.0, least(1.0, 0.6 + 0.36 * (dx + dy))))))) AS INT) AS grey FROM (SELECT *, {_slope('py', 'px')} AS dx, {_slope('px', 'py')} AS dy FROM fx_pixel WHERE h > -32000) s",
    "downsample": f"SELECT z, x, y, px, py, round(h, 6) AS h FROM {_DOWN.format('fx_pixel')} p WHERE h IS NOT NULL",
    "pyramid": f"SELECT z, count(*) AS pixels, round(sum(h), 2) AS total FROM (SELECT * FROM {_P0} a UNION ALL SELECT * FROM {_P1} b UNION ALL SELECT * FROM {_P2} c UNION ALL SELECT * FROM {_P3} d) u GROUP BY z",
    "encode_decode": "SELECT vec_id, px, py, CAST(floor(w / 256.0) % 256 AS BIGINT) AS red, CAST(w % 256 AS BIGINT) AS green, CAST(floor((e - w) * 256) AS BIGINT) AS blue, round(floor(w / 256.0) % 256 * 256.0 + w % 256 + floor((e - w) * 256) / 256.0 - 32768.0, 6) AS metres FROM (SELECT *, floor(e) AS w FROM (SELECT vec_id, px, py, greatest(0.0, least(65535.99, h + 32768.0)) AS e FROM fx_pixel) a) b",
    "overview": "SELECT tx, ty, round(avg(m), 4) AS mean_m, count(*) - count(m) AS missing FROM (SELECT t.tx, t.ty, p.m FROM (SELECT DISTINCT x >> 2 AS tx, y >> 2 AS ty FROM fx_pixel WHERE h > -32000) t CROSS JOIN range(4) i(i) CROSS JOIN range(4) j(j) LEFT JOIN (SELECT x, y, avg(h) AS m FROM fx_pixel WHERE h > -32000 GROUP BY x, y) p ON p.x = t.tx * 4 + i.i AND p.y = t.ty * 4 + j.j) q GROUP BY tx, ty",
    "points_in_zone": f"SELECT * FROM {_IN} i",
    "points_in_any_zone": f"SELECT point_id, count(*) AS zones FROM {_IN} i GROUP BY point_id",
    "cells_in_zone": f"SELECT DISTINCT cell_key FROM {_inside('(SELECT cell_key, (south + north) / 2 AS lat, (west + east) / 2 AS lon FROM fx_cell_box)', 'cell_key')} i",
    "zone_band": f"SELECT * FROM {_BAND} b",
    "zone_rule": f"SELECT point_id, CASE WHEN band IN ('inside', 'soft') THEN 'allow' ELSE 'deny' END AS rule FROM {_BAND} b",
    "shared_border": f"SELECT DISTINCT v.own AS zone_id, v.seq, e.zone_id AS other_id FROM (SELECT zone_id AS own, seq, {_BX.format(lon='lon')} AS x, {_BZ.format(lat='lat')} AS z FROM fx_zone_vertex) v JOIN {_EB} e ON e.zone_id <> v.own WHERE {_DIST} <= 240.0",
    "largest_part": f"SELECT country, arg_max(zone_id, (round(area, 9), -zone_id)) AS zone_id, round(max(area), 6) AS area FROM (SELECT zone_id, zone_id % 10 AS country, abs(sum(lon * lat2 - lon2 * lat)) / 2 AS area FROM {_EDGE} e GROUP BY zone_id) a GROUP BY country",
    "reprojected_rings": f"SELECT zone_id, seq, round({_BX.format(lon='lon')}, 4) AS x, round({_BZ.format(lat='lat')}, 4) AS z FROM fx_zone_vertex",
    "zone_members": "SELECT s_name AS zone, s_nationkey AS country_id FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "realm_join": f"SELECT point_id, {_RB} AS realm FROM fx_point",
}
