"""Queries of the composed jobs and of what has no query of its own elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.functions import geo
from tessera.operators import coverage, generate, raster, zones
from tessera.operators.lineage import shared_folder
from tessera.operators.plan import PLAN
from tessera.plans import pipelines
from tessera.queries import coords, planning, rasters
from tessera.queries import runs as _runs
from tessera.sources import readers

OLAT, OLON, SCALE = 45.0, 25.0, 0.3


def _plan(spark, d):
    return view(spark, d, "fx_plan").select(*PLAN)


def bake_incremental(spark, d):
    """Counts of the target tiles that aren't cached yet, from three sources: one that has all, one with copies, and one elsewhere.

    The one elsewhere has its elements under the same ids and comes first in order, so it counts unless it is left out.
    """
    nodes, refs, members = view(spark, d, "fx_node"), view(spark, d, "fx_way_ref"), view(spark, d, "fx_rel_member")
    targets = view(spark, d, "fx_node_tile").select("x", "y").distinct()
    ends = nodes.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    named = F.explode(F.array(*[F.lit(n) for n in ("a elsewhere", "b", "c copies")])).alias("source")
    far = lambda c: F.when(F.col("source") == "a elsewhere", F.col(c) - 30.0).otherwise(F.col(c)).alias(c)
    sources = ends.select("*", named).select("source", *[far(c) for c in generate.SIDES])
    each = [df.select("*", named).select("source", *[far(c) if c == "lat" else c for c in df.columns]) for df in (nodes, refs, members)]
    return pipelines.bake(*each, targets, view(spark, d, "fx_cached_tile").select("x", "y"), sources)[1]


def pack_status(spark, d):
    """Packs of cells in degrees, at the zoom and with the margins that generating them needs."""
    boxes = view(spark, d, "fx_cell_box").select(F.col("cell_key").alias("name"), *generate.SIDES)
    cached = view(spark, d, "fx_tile_level").where("has_data").select("z", (F.col("x") + 4660).alias("x"), (F.col("y") + 2940).alias("y"))
    return pipelines.pack_status(boxes, cached, SCALE).drop("bbox")


def elevation_lock(spark, d):
    """Heights under boxes around five columns of raster tiles each, at the tiles' own zoom."""
    tiles = rasters._tiles(spark, d).select("z", "x", "y", "h")
    box = geo.tile_bbox("x", "y", 13)
    inner = tiles.select(F.floor(F.col("x") / 5).cast("int").alias("box_id"), *[(c + (1e-7 if s in ("south", "west") else -1e-7)).alias(s) for s, c in box.items()])
    return pipelines.elevation_lock(coverage.union_bbox(inner, "box_id"), tiles, rasters.W, 13, 2)


def plan_selection(spark, d):
    return pipelines.plan_selection(_plan(spark, d), view(spark, d, "fx_zone_vertex"), OLAT, OLON, SCALE, 16).select("cell_key", "status")


def download_plan(spark, d):
    fresh = F.col("x") % 4 != 0
    catalogue = view(spark, d, "fx_cached_tile").select("z", "x", "y", F.when(F.col("y") % 11 == 0, 2).otherwise(900).alias("size"), F.when(fresh, 3).otherwise(90).alias("age_days"), F.when(F.col("y") % 13 == 0, "]").otherwise("} \n").alias("tail"))
    return pipelines.download_plan(view(spark, d, "fx_cell_box"), catalogue, 2, OLAT, OLON, SCALE, 3000.0)


def merge_check(spark, d):
    files = view(spark, d, "fx_region_file").withColumn("sub", F.lit("region"))
    return pipelines.merge_check(files, _plan(spark, d), planning._master(spark, d))


def merge_into(spark, d):
    """What a merge leaves in the master: the regions that cells own, read again from where they were written."""
    files = view(spark, d, "fx_region_file").withColumn("sub", F.lit("region"))
    path = f"{shared_folder(spark)}/master-{uuid.uuid4().hex}"
    pipelines.merge_into(files, _plan(spark, d), path)
    return spark.read.parquet(path).select("cell_key", "reg_x", "reg_z")


def gap_list(spark, d):
    files = view(spark, d, "fx_region_file").where("reg_x % 5 <> 0")
    return pipelines.gap_list(_plan(spark, d), files)


def run_report(spark, d):
    from tessera.queries.runs import _samples

    report = pipelines.run_report(view(spark, d, "fx_cell_event"), _samples(spark, d), _plan(spark, d))
    lines = lambda of, *parts: F.array_join(F.transform(of, lambda r: F.concat_ws(":", *[p(r) for p in parts])), ";").alias(of)
    part = lambda name: lambda r: r[name].cast("string")
    share = lambda name: lambda r: F.round(r[name] * 10000).cast("long").cast("string")
    nested = [
        lines("cells", part("place"), part("cell_key"), part("status")),
        lines("timeline", lambda r: F.unix_seconds(r["t"].cast("timestamp")).cast("string"), *map(part, ("active", "done", "failed", "cpu", "ram", "merged"))),
        lines("lanes", part("lane"), part("cell_key"), share("from"), share("to")),
    ]
    names = ("total", "merged", "failed", "incomplete", "retries", "cell_median_s", "elapsed_s", "workers_peak", "cpu_avg", "ram_peak")
    return report.select(*[F.col(f"summary.{n}").alias(n) for n in names], *nested)


def _zones(spark, d):
    borders = view(spark, d, "fx_zone_vertex")
    countries = borders.select(F.col("zone").alias("name"), F.col("zone_id").alias("country_id")).distinct()
    spec = countries.select(F.concat(F.lit("z"), (F.col("country_id") % 2).cast("string")).alias("zone"), F.array(F.upper("name")).alias("names"))
    return spec, countries, borders


def zone_points(spark, d):
    points = view(spark, d, "fx_point").select("point_id", "lat", "lon")
    return pipelines.zone_points(points, *_zones(spark, d), OLAT, OLON, SCALE, 5.0, 15.0).select("point_id", "band", "rule")


def zone_outlines(spark, d):
    """Outlines of at most four points in whole blocks, and the vertices on shared borders."""
    spec, countries, borders = _zones(spark, d)
    uneven = borders.withColumns({"lon": F.col("lon") + F.col("seq") * 0.002, "lat": F.col("lat") + F.col("seq") % 3 * 0.003})  # so that no two points are as far off
    outline, shared = pipelines.zone_outlines(spec, countries, uneven, OLAT, OLON, SCALE, 4)
    shown = outline.select("zone_id", "seq", "x", "z", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    return shown.unionByName(shared.select("zone_id", "seq", "other_id"), allowMissingColumns=True)


def raster_repair(spark, d):
    out = pipelines.raster_repair(rasters._tiles(spark, d), rasters._parent_tiles(spark, d), rasters.W, 2)
    return raster.pixels(out, rasters.W).where("h is not null").groupBy("z").agg(F.count("*").alias("pixels"), F.count_if(F.col("h") > raster.NO_DATA).alias("valid"), F.round(F.sum(F.when(F.col("h") > raster.NO_DATA, F.col("h"))), 1).alias("total"))


def upsample(spark, d):
    tiles = view(spark, d, "fx_raster").where("not is_hole").select((F.col("z") + 1).alias("z"), (F.col("x") * 2).alias("x"), (F.col("y") * 2 + 1).alias("y"))
    out = raster.pixels(raster.upsample(tiles, rasters._tiles(spark, d), 13, rasters.W), rasters.W)
    return out.withColumn("h", F.round(F.col("h") + 1e-7, 3))


def source_extents(spark, d):
    """Sources by path, the largest of repeated ones."""
    o = view(spark, d, "orders").select((F.col("o_custkey") % 500).cast("string").alias("path"), (F.col("o_orderkey") * 10).alias("length"), (F.col("o_orderkey") % 180 - 90.0).alias("south"))
    return readers.scan_sources(o)


QUERIES = {
    f.__name__: f
    for f in (
        bake_incremental, pack_status, elevation_lock, plan_selection, download_plan, merge_check, merge_into, gap_list, run_report,
        zone_points, zone_outlines, raster_repair, upsample, source_extents,
    )
}

_C = "(SELECT DISTINCT x, y FROM fx_node_tile n WHERE NOT EXISTS (SELECT 1 FROM fx_cached_tile t WHERE t.x = n.x AND t.y = n.y))"
_LOC = "(SELECT w.way_id, w.ref, n.lon, n.lat, n.x, n.y FROM fx_way_ref w JOIN fx_node_tile n ON n.id = w.ref)"
_EMIT = f"(SELECT DISTINCT l.way_id, l.x, l.y FROM {_LOC} l JOIN {_C} c ON c.x = l.x AND c.y = l.y)"
_BAND = rasters._BAND
_PAD_LAT, _PAD_LON = f"((512 + 8 * 16) / CAST(0.3 AS DOUBLE) + 256) / {coords.M}", f"((512 + 8 * 16) / CAST(0.3 AS DOUBLE) + 256) / ({coords.M} * cos(radians((south + north) / 2)))"


def _tiles_of(side, lat, z="zoom"):
    at = f"(1.0 - asinh(tan(radians({side}))) / pi()) / 2.0 * (1 << {z})" if lat else f"({side} + 180.0) / 360.0 * (1 << {z})"
    return f"CAST(greatest(0, least((1 << {z}) - 1, floor({at}))) AS INT)"


_PACKS = f"""(SELECT *, CAST(greatest(11, least(15, round_even(15.0 - log2((1.0 / CAST(0.3 AS DOUBLE)) / (40075016.0 / (256.0 * 32768.0) * cos(radians((south + north) / 2)))), 0))) AS INT) AS zoom,
 substr(sha1(printf('%.4f,%.4f,%.4f,%.4f|%s', south, west, north, east, lower(trim(cell_key)))), 1, 16) AS region_id FROM fx_cell_box)"""
_READ = f"""(SELECT *, unnest(range({_tiles_of(f'(south - {_PAD_LAT})', True)}, {_tiles_of('n', True)} - 1, -1)) AS y FROM (SELECT *, unnest(range({_tiles_of(f'(west - {_PAD_LON})', False)}, {_tiles_of(f'(east + {_PAD_LON})', False)} + 1)) AS x, north + {_PAD_LAT} AS n FROM {_PACKS} a) b)"""


def _quadtree(cells, budget, levels=6):
    """Common table expressions ``q0`` to ``q<levels>`` of cells with their group after each level."""
    out = [f"q0 AS MATERIALIZED (SELECT *, '' AS grp FROM {cells} c)"]
    for k in range(levels):
        area = f"abs((max(north) - min(south)) * {coords.M} / 1000 * (max(east) - min(west)) * {coords.M} * cos(radians((min(south) + max(north)) / 2)) / 1000)"
        out.append(
            f"q{k + 1} AS MATERIALIZED (SELECT q.* EXCLUDE (grp), CASE WHEN f.n > 1 AND f.km2 > {budget} AND length(q.grp) = {k} THEN q.grp || CAST(CAST(rx >= mx AS INT) + 2 * CAST(rz >= mz AS INT) AS VARCHAR) ELSE q.grp END AS grp"
            f" FROM q{k} q JOIN (SELECT grp, count(*) AS n, floor((min(rx) + max(rx) + 1) / 2.0) AS mx, floor((min(rz) + max(rz) + 1) / 2.0) AS mz, {area} AS km2 FROM q{k} GROUP BY grp) f ON f.grp = q.grp)"
        )
    return ", ".join(out)


_SEAM = "(SELECT cell_key, rx, rz, " + ", ".join(f"{c} AS {s}" for s, c in coords._EXP.items()) + " FROM fx_cell_box)"
_SEAM_TILES = f"(SELECT cell_key, grp, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT *, unnest(range({coords._ty('north', 11)}, {coords._ty('south', 11)} + 1)) AS y FROM (SELECT *, unnest(range({coords._tx('west', 11)}, {coords._tx('east', 11)} + 1)) AS x FROM q6) a) b)"
_FRESH = "(SELECT x, y FROM fx_cached_tile WHERE x % 4 <> 0 AND y % 11 <> 0 AND y % 13 <> 0)"
#: Douglas-Peucker on rings of six points: intervals, each split at its farthest point while that is further off than ``eps``.
_DEEP_SPLIT = """keep AS (WITH RECURSIVE v AS MATERIALIZED (SELECT zone_id, seq, {lon} AS lon, {lat} AS lat FROM fx_zone_vertex),
 s(zone_id, a, b) AS (SELECT zone_id, min(seq), max(seq) FROM v GROUP BY zone_id UNION ALL
 SELECT zone_id, unnest([a, k]), unnest([k, b]) FROM (SELECT s.zone_id, s.a, s.b, arg_max(v.seq, (d, -v.seq)) AS k, max(d) AS far FROM (SELECT s.zone_id, s.a, s.b, v.seq,
 sqrt(pow(v.lat - p.lat - t * (q.lat - p.lat), 2) + pow(v.lon - p.lon - t * (q.lon - p.lon), 2)) AS d FROM (SELECT s.*, v.seq, greatest(0.0, least(1.0, ((v.lat - p.lat) * (q.lat - p.lat) + (v.lon - p.lon) * (q.lon - p.lon)) / (pow(q.lat - p.lat, 2) + pow(q.lon - p.lon, 2)))) AS t
 FROM s JOIN v ON v.zone_id = s.zone_id AND v.seq > s.a AND v.seq < s.b JOIN v p ON p.zone_id = s.zone_id AND p.seq = s.a JOIN v q ON q.zone_id = s.zone_id AND q.seq = s.b) s
 JOIN v ON v.zone_id = s.zone_id AND v.seq = s.seq JOIN v p ON p.zone_id = s.zone_id AND p.seq = s.a JOIN v q ON q.zone_id = s.zone_id AND q.seq = s.b) s JOIN v ON v.zone_id = s.zone_id AND v.seq = s.seq GROUP BY s.zone_id, s.a, s.b) f WHERE far > {eps})
 SELECT zone_id, a AS seq FROM s UNION SELECT zone_id, b FROM s)"""


def _few(lon, lat, target):
    """Common table expressions ending in ``few``: rings of six points with ``target`` of them at most.

    A point stays as long as the tolerance is below all distances on its way down the splits; so the
    least tolerance on the grid of halvings is the next one from the first of those distances that has to go.
    """
    width = f"({zones.MOST_TOLERANCE} / {1 << zones.HALVINGS})"
    return f"""v AS MATERIALIZED (SELECT zone_id, seq, {lon} AS lon, {lat} AS lat FROM fx_zone_vertex),
 worth AS MATERIALIZED (WITH RECURSIVE s(zone_id, a, b, least_far) AS (SELECT zone_id, min(seq), max(seq), 1e300 FROM v GROUP BY zone_id UNION ALL
 SELECT zone_id, unnest([a, k]), unnest([k, b]), least(least_far, far) FROM (SELECT s.zone_id, s.a, s.b, s.least_far, arg_max(v.seq, (d, -v.seq)) AS k, max(d) AS far FROM (SELECT s.*, sqrt(pow(v.lat - p.lat - t * (q.lat - p.lat), 2) + pow(v.lon - p.lon - t * (q.lon - p.lon), 2)) AS d FROM (
 SELECT s.*, v.seq, greatest(0.0, least(1.0, ((v.lat - p.lat) * (q.lat - p.lat) + (v.lon - p.lon) * (q.lon - p.lon)) / (pow(q.lat - p.lat, 2) + pow(q.lon - p.lon, 2)))) AS t
 FROM s JOIN v ON v.zone_id = s.zone_id AND v.seq > s.a AND v.seq < s.b JOIN v p ON p.zone_id = s.zone_id AND p.seq = s.a JOIN v q ON q.zone_id = s.zone_id AND q.seq = s.b) s
 JOIN v ON v.zone_id = s.zone_id AND v.seq = s.seq JOIN v p ON p.zone_id = s.zone_id AND p.seq = s.a JOIN v q ON q.zone_id = s.zone_id AND q.seq = s.b) s JOIN v ON v.zone_id = s.zone_id AND v.seq = s.seq GROUP BY s.zone_id, s.a, s.b, s.least_far) f)
 SELECT zone_id, seq, max(far) AS far FROM (SELECT zone_id, a AS seq, least_far AS far FROM s UNION ALL SELECT zone_id, b, 1e300 FROM s WHERE least_far = 1e300) e GROUP BY zone_id, seq),
 tolerance AS (SELECT zone_id, greatest(1, ceil(max(far) / {width})) * {width} AS eps FROM (SELECT zone_id, far, row_number() OVER (PARTITION BY zone_id ORDER BY far DESC) AS place FROM worth) w WHERE place > {target} GROUP BY zone_id),
 few AS (SELECT v.zone_id, CAST(row_number() OVER (PARTITION BY v.zone_id ORDER BY v.seq) - 1 AS INT) AS seq, v.lon, v.lat FROM v JOIN worth w ON w.zone_id = v.zone_id AND w.seq = v.seq LEFT JOIN tolerance t ON t.zone_id = v.zone_id WHERE t.eps IS NULL OR w.far > t.eps)"""


_RING = "(SELECT v.* FROM fx_zone_vertex v JOIN keep k ON k.zone_id = v.zone_id AND k.seq = v.seq WHERE (SELECT count(*) FROM keep n WHERE n.zone_id = v.zone_id) >= 3 UNION ALL SELECT * FROM fx_zone_vertex w WHERE (SELECT count(*) FROM keep n WHERE n.zone_id = w.zone_id) < 3)"
_UP = """(SELECT z + 1 AS z, x * 2 AS x, y * 2 + 1 AS y, i AS px, j AS py, (1 - fx) * (1 - fy) * p00 + fx * (1 - fy) * p10 + (1 - fx) * fy * p01 + fx * fy * p11 AS h FROM (
 SELECT t.z, t.x, t.y, g.i, g.j, g.sx - floor(g.sx) AS fx, g.sy - floor(g.sy) AS fy, a.h AS p00, b.h AS p10, c.h AS p01, e.h AS p11
 FROM (SELECT z, x, y FROM fx_raster WHERE NOT is_hole) t
 CROSS JOIN (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, greatest(0.0, least(3.0, (i + 0.5) / 2.0 - 0.5)) AS sx, greatest(0.0, least(3.0, (j + 0.5) / 2.0 - 0.5)) AS sy FROM range(8) r(i) CROSS JOIN range(8) s(j)) g
 JOIN fx_pixel a ON a.x = t.x AND a.y = t.y AND a.px = floor(sx) AND a.py = 4 + floor(sy) JOIN fx_pixel b ON b.x = t.x AND b.y = t.y AND b.px = least(floor(sx) + 1, 3) AND b.py = 4 + floor(sy)
 JOIN fx_pixel c ON c.x = t.x AND c.y = t.y AND c.px = floor(sx) AND c.py = 4 + least(floor(sy) + 1, 3) JOIN fx_pixel e ON e.x = t.x AND e.y = t.y AND e.px = least(floor(sx) + 1, 3) AND e.py = 4 + least(floor(sy) + 1, 3)) q)"""

_WORST = f"(SELECT * FROM (SELECT cell_key, status, row_number() OVER (ORDER BY CASE WHEN {_runs._FAILS} THEN 0 WHEN status <> 'merged' THEN 1 ELSE 2 END, coalesce(duration_s, 0) DESC, cell_key) AS place FROM {_runs._CELLS_ALL} c) r WHERE place <= 200)"

SQL = {
    "bake_incremental": f"""SELECT t.x, t.y, count(*) FILTER (kind = 'node') AS n_node, count(*) FILTER (kind = 'foreign') AS n_foreign, count(*) FILTER (kind = 'way') AS n_way, count(*) FILTER (kind = 'relation') AS n_relation, count(kind) = 0 AS empty
 FROM {_C} t LEFT JOIN (SELECT x, y, 'node' AS kind FROM fx_node_tile UNION ALL SELECT x, y, 'way' FROM {_EMIT} e
 UNION ALL SELECT x, y, 'foreign' FROM (SELECT DISTINCT e.x, e.y, l.ref FROM {_EMIT} e JOIN {_LOC} l ON l.way_id = e.way_id WHERE l.x <> e.x OR l.y <> e.y) f
 UNION ALL SELECT x, y, 'relation' FROM (SELECT DISTINCT m.rel_id, e.x, e.y FROM fx_rel_member m JOIN {_EMIT} e ON m.ref = e.way_id) r) k ON k.x = t.x AND k.y = t.y GROUP BY t.x, t.y""",
    "pack_status": f"SELECT region_id, cell_key AS name, CAST(zoom AS INT) AS zoom, count(*) AS total, count(t.x) AS cached, {planning._PCT} AS pct FROM {_READ} r LEFT JOIN (SELECT z, x + 4660 AS x, y + 2940 AS y FROM fx_tile_level WHERE has_data) t ON t.z = r.zoom AND t.x = r.x AND t.y = r.y GROUP BY region_id, cell_key, zoom",
    "elevation_lock": f"SELECT round(min(h) FILTER (ok), 1) AS min_m, round(max(h) FILTER (ok), 1) AS max_m, count(DISTINCT vec_id) FILTER (ok) AS tiles, count(*) FILTER (ok) > 0 AS ok, box_id FROM (SELECT *, h BETWEEN -500 AND 9000 AS ok, CAST(floor(x / 5.0) AS INT) AS box_id FROM {rasters._S} s) b GROUP BY box_id",
    "download_plan": f"WITH {_quadtree(_SEAM, 3000.0)}, t AS MATERIALIZED (SELECT c.*, f.x IS NOT NULL AS ok FROM {_SEAM_TILES} c LEFT JOIN {_FRESH} f ON f.x = c.x AND f.y = c.y), s AS (SELECT grp, cell_key, bool_and(ok) AS served FROM t GROUP BY grp, cell_key) SELECT grp, count(*) AS n_cells, count(*) FILTER (served) AS n_served, CASE WHEN count(*) FILTER (served) = 0 THEN 'failed' ELSE 'cached' END AS state FROM s GROUP BY grp",
    "merge_into": f"SELECT cell_key, CAST(reg_x AS INT) AS reg_x, CAST(reg_z AS INT) AS reg_z FROM {planning._FILES} f WHERE own",
    "run_report": f"""SELECT total, merged, failed, incomplete, retries, cell_median_s, elapsed_s, workers_peak, cpu_avg, ram_peak,
 (SELECT string_agg(concat_ws(':', place, cell_key, status), ';' ORDER BY place) FROM {_WORST} w) AS cells,
 (SELECT string_agg(concat_ws(':', t, active, done, failed, cpu, ram, m), ';' ORDER BY t) FROM (SELECT *, greatest(0, coalesce(done - lag(done) OVER (ORDER BY t), 0)) AS m, row_number() OVER (ORDER BY t DESC) AS place FROM {_runs._LINE} b) c WHERE place <= 360) AS timeline,
 (SELECT coalesce(string_agg(concat_ws(':', lane, cell_key, CAST(round(f * 10000) AS BIGINT), CAST(round(u * 10000) AS BIGINT)), ';' ORDER BY lane, f, u, cell_key), '') FROM (
 SELECT cell_key, dense_rank() OVER (ORDER BY worker) - 1 AS lane, round((s - min(s) OVER ()) / (max(e) OVER () - min(s) OVER ()), 6) AS f, round((e - min(s) OVER ()) / (max(e) OVER () - min(s) OVER ()), 6) AS u FROM (
 SELECT cell_key, worker, epoch_us(started) / 1e6 AS s, epoch_us(ended) / 1e6 AS e FROM {_runs._TIMING} x WHERE ended >= started AND worker IS NOT NULL) y) l WHERE cell_key IN (SELECT cell_key FROM {_WORST} w)) AS lanes FROM {_runs._SUMMARY_ALL} s""",
    "zone_outlines": f"""WITH {_few(rasters._BX.format(lon='(lon + seq * 0.002)'), rasters._BZ.format(lat='(lat + seq % 3 * 0.003)'), 4)}
 SELECT zone_id, seq, x, z, round(25.0 + x / (111320.0 * cos(radians(45.0)) * 0.3), 6) AS lon, round(45.0 - z / (111320.0 * CAST(0.3 AS DOUBLE)), 6) AS lat, CAST(NULL AS INT) AS other_id FROM (
 SELECT zone_id, seq, round_even(lon, 0) AS x, round_even(lat, 0) AS z FROM few) o UNION ALL SELECT zone_id, seq, NULL, NULL, NULL, NULL, other_id FROM ({rasters.SQL['shared_border'].replace('fx_zone_vertex', '(SELECT zone_id, seq, lon + seq * 0.002 AS lon, lat + seq % 3 * 0.003 AS lat FROM fx_zone_vertex)')}) b""",
    "merge_check": f"""SELECT p.cell_key, CASE WHEN f.n IS NULL THEN 'empty' ELSE 'ok' END AS "check", f.copied, f.skipped, f.collisions, f.subs FROM fx_plan p
 LEFT JOIN (SELECT f.cell_key, count(*) AS n, count(*) FILTER (own) AS copied, count(*) FILTER (NOT own) AS skipped, count(*) FILTER (own AND (f.reg_x + f.reg_z) % 3 = 0) AS collisions, CASE WHEN bool_or(own) THEN 'region' ELSE '' END AS subs FROM {planning._FILES} f GROUP BY f.cell_key) f ON f.cell_key = p.cell_key""",
    "gap_list": planning.SQL["missing_cells"].replace("WHERE f.reg_x = w.x", "WHERE f.reg_x % 5 <> 0 AND f.reg_x = w.x"),
    "zone_points": f"SELECT point_id, band, CASE WHEN band IN ('inside', 'soft') THEN 'allow' ELSE 'deny' END AS rule FROM {_BAND} b",
    "raster_repair": f"WITH p0 AS MATERIALIZED (SELECT p.z, p.x, p.y, p.px, p.py, coalesce(o.h, p.h) AS h FROM fx_pixel p LEFT JOIN {rasters._OZ} o ON o.x = p.x AND o.y = p.y AND o.px = p.px AND o.py = p.py), p1 AS MATERIALIZED {rasters._DOWN.format('p0')}, p2 AS {rasters._DOWN.format('p1')} SELECT z, count(*) AS pixels, count(*) FILTER (h > -32000) AS valid, round(sum(h) FILTER (h > -32000), 1) AS total FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) u WHERE h IS NOT NULL GROUP BY z",
    "upsample": f"SELECT z, x, y, px, py, round(h + 1e-7, 3) AS h FROM {_UP} u",
    "source_extents": "SELECT CAST(o_custkey % 500 AS VARCHAR) AS path, max(o_orderkey * 10) AS length, arg_max(o_orderkey % 180 - CAST(90.0 AS DOUBLE), o_orderkey) AS south FROM orders GROUP BY 1",
}
_CENTRED = "(SELECT *, (south + north) / 2 AS lat, (west + east) / 2 AS lon FROM (SELECT rx, rz, cell_key, 45.0 + rz * {h} AS south, 45.0 + (rz + 1) * {h} AS north, 25.0 + rx * {w} AS west, 25.0 + (rx + 1) * {w} AS east FROM (SELECT DISTINCT rx, rz, concat(CAST(rx AS VARCHAR), ',', CAST(rz AS VARCHAR), ',16') AS cell_key FROM (SELECT *, unnest(range(CAST(floor((west - 25.0) / {w}) AS BIGINT), CAST(ceil((east - 25.0) / {w}) AS BIGINT))) AS rx FROM (SELECT *, unnest(range(CAST(floor((south - 45.0) / {h}) AS BIGINT), CAST(ceil((north - 45.0) / {h}) AS BIGINT))) AS rz FROM (SELECT zone_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM ring GROUP BY zone_id) b) c) e) g) k)".format(
    h="(16 * 512 / CAST(0.3 AS DOUBLE) / 111320.0)", w="(16 * 512 / CAST(0.3 AS DOUBLE) / (111320.0 * cos(radians(45.0))))"
)
_CHOSEN = f"(SELECT DISTINCT cell_key FROM (SELECT p.cell_key, e.zone_id FROM {_CENTRED} p JOIN edge e ON (e.lat2 > p.lat) <> (e.lat > p.lat) AND p.lon < (e.lon - e.lon2) * (p.lat - e.lat2) / (e.lat - e.lat2 + 1e-18) + e.lon2 GROUP BY p.cell_key, e.zone_id HAVING count(*) % 2 = 1) i)"
_EPS = "0.7 * greatest(16 * 512 / CAST(0.3 AS DOUBLE) / 111320.0, 16 * 512 / CAST(0.3 AS DOUBLE) / (111320.0 * cos(radians((SELECT avg(lat) FROM fx_zone_vertex)))))"
SQL["plan_selection"] = f"""WITH {_DEEP_SPLIT.format(lon='lon', lat='lat', eps=f'({_EPS})')}, ring AS MATERIALIZED {_RING},
 edge AS (SELECT zone_id, lon, lat, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2 FROM ring WINDOW w AS (PARTITION BY zone_id ORDER BY seq))
 SELECT cell_key, status FROM fx_plan UNION ALL SELECT cell_key, 'planned' FROM {_CHOSEN} c WHERE cell_key NOT IN (SELECT cell_key FROM fx_plan)"""
rasters.SQL["simplify_ring"] = f"WITH {_DEEP_SPLIT.format(lon='lon', lat='lat', eps='0.11')}, ring AS {_RING} SELECT zone_id, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY seq) - 1 AS INT) AS seq, lon, lat FROM ring"
planning.SQL["download_groups"] = f"""WITH {_quadtree('fx_cell_box', 3000.0)} SELECT grp, substr(sha1(printf('%.7f,%.7f,%.7f,%.7f|groups', south, west, north, east)), 1, 16) AS id, n_cells, cells, round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east FROM (
 SELECT grp, n_cells, cells, s - 250.0 / {coords.M} AS south, w - 250.0 / ({coords.M} * cos(radians((s + n) / 2))) AS west, n + 250.0 / {coords.M} AS north, e + 250.0 / ({coords.M} * cos(radians((s + n) / 2))) AS east FROM (
 SELECT grp, count(*) AS n_cells, string_agg(cell_key, ';' ORDER BY cell_key) AS cells, min(south) AS s, min(west) AS w, max(north) AS n, max(east) AS e FROM q6 GROUP BY grp) g) h"""
rasters.SQL["simplify_to"] = f"WITH {_few('lon * 1000', 'lat * 1000', 4)} SELECT zone_id, seq, round_even(lon, 0) AS lon, round_even(lat, 0) AS lat FROM few"
