"""Queries of coverage, plan algebra and merging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.functions import geo
from tessera.operators import coverage as cov
from tessera.operators import generate as g
from tessera.operators import merge, plan
from tessera.operators.lineage import shared_folder
from tessera.sources import readers, writers

OLAT, OLON, SCALE = 45.0, 25.0, 0.3


def _needed(spark, d):
    return view(spark, d, "fx_node_tile").select(F.lit(11).alias("z"), "x", "y").distinct()


def coverage_missing(spark, d):
    return cov.missing_tiles(_needed(spark, d), view(spark, d, "fx_cached_tile"))


def coverage_pct(spark, d):
    needed = _needed(spark, d).withColumn("band", F.col("x") % 7)
    return cov.coverage(needed, view(spark, d, "fx_cached_tile"), "band").unionByName(
        cov.coverage(needed, view(spark, d, "fx_cached_tile")).withColumn("band", F.lit(-1))
    )


def _covering(spark, d):
    boxes = view(spark, d, "fx_cell_box")
    return g.tiles_for_bbox(boxes.select("cell_key", *g.SIDES), 11).select("cell_key", "z", "x", "y")


def cells_served(spark, d):
    tiles = view(spark, d, "fx_cached_tile").withColumn("ok", F.lit(True))
    return cov.cells_served(_covering(spark, d), tiles)


def fresh_tiles(spark, d):
    e = view(spark, d, "events").select("event_id", (F.col("event_id") % 9000).alias("size"), (F.col("user_id") % 60).alias("age"), F.when(F.col("event_id") % 11 == 0, "x").otherwise("..} ").alias("tail"))
    return e.select("event_id", cov.is_fresh("size", "age", "tail").alias("fresh"), cov.is_junk("size").alias("junk"), cov.maybe_hole("size").alias("maybe_hole"))


def cache_info(spark, d):
    e = view(spark, d, "events").select("event_type", (F.col("event_id") % 9000).alias("length"))
    return cov.cache_info(e.withColumnRenamed("event_type", "kind"))


def selection_bbox(spark, d):
    boxes = cov.union_bbox(view(spark, d, "fx_cell_box"), "status")
    return boxes.select("status", *[F.round(s, 6).alias(s) for s in g.SIDES])


def outcome_counts(spark, d):
    code, size = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(500), F.lit(403), F.lit(200)), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_id") % 200
    from tessera.functions.text import tile_outcome

    ledger = view(spark, d, "events").select("event_type", tile_outcome(code, size).alias("outcome"))
    return cov.outcome_counts(ledger, ("ok", "absent", "fail"), "event_type")


def download_groups_depth1(spark, d):
    cells = view(spark, d, "fx_cell_box")
    return cov.plan_groups(cells, 1.0, max_depth=1).select("cell_key", "grp")


def download_groups(spark, d):
    cells = view(spark, d, "fx_cell_box")
    groups = cov.preview_groups(cov.plan_groups(cells, 3000.0), 250.0)
    return groups.select("grp", "id", "n_cells", "cells", *[F.round(s, 6).alias(s) for s in g.SIDES])


def group_state(spark, d):
    grouped = cov.plan_groups(view(spark, d, "fx_cell_box"), 1.0, max_depth=1).select("cell_key", "grp")
    served = cov.cells_served(_covering(spark, d), view(spark, d, "fx_cached_tile").withColumn("ok", F.lit(True)))
    tiles = grouped.join(_covering(spark, d), "cell_key").join(view(spark, d, "fx_cached_tile").withColumn("state", F.when(F.col("x") % 5 == 0, "done").otherwise("cached")), ["z", "x", "y"])
    return cov.group_state(grouped.join(served, "cell_key"), tiles)


def import_new(spark, d):
    incoming = view(spark, d, "fx_tile_level").select("z", "x", "y")
    known = view(spark, d, "fx_tile_level").where("has_data").select("z", "x", "y")
    return cov.import_new(incoming, known, "z", "x", "y")


def import_counts(spark, d):
    incoming = view(spark, d, "fx_tile_level").select("z", "x", "y")
    return cov.import_counts(incoming, view(spark, d, "fx_tile_level").where("has_data"), "z", "z", "x", "y")


def pack_list(spark, d):
    """Packs (suppliers' boxes) listed from their manifests, their coverage computed again from the catalogue."""
    packs = cov.union_bbox(view(spark, d, "fx_zone_vertex").select("zone", F.col("lat").alias("south"), F.col("lon").alias("west"), F.col("lat").alias("north"), F.col("lon").alias("east")), "zone")
    box = {s: F.col(s) for s in g.SIDES}
    unknown = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cached"), F.lit(0.0).alias("pct"))
    path = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    writers.write_manifest(packs.select(geo.region_id(box, "zone").alias("region_id"), F.col("zone").alias("name"), F.struct(*g.SIDES).alias("bbox"), F.lit(11).alias("zoom"), unknown.alias("elevation"), unknown.alias("osm")), path)
    listed = readers.list_packs(spark, path, view(spark, d, "fx_cached_tile"))
    return listed.select("region_id", F.col("name").alias("zone"), "total", "cached", "pct")


def _p(spark, d):
    return view(spark, d, "fx_plan").select(*plan.PLAN)


def _area(spark, d):
    p = _p(spark, d)
    moved = p.select((F.col("rx") + 3).alias("rx"), (F.col("rz") - 2).alias("rz"), "size")
    return moved.withColumn("cell_key", geo.cell_key("rx", "rz", "size")).withColumn("status", F.lit("planned"))


def plan_add(spark, d):
    return plan.add(_p(spark, d), _area(spark, d)).select("cell_key", "status")


def plan_remove(spark, d):
    return plan.remove(_p(spark, d), _area(spark, d)).select("cell_key", "status")


def plan_toggle(spark, d):
    return plan.toggle(_p(spark, d), _area(spark, d)).select("cell_key", "rx", "rz", "status")


def plan_clear(spark, d):
    return plan.clear_counts(_p(spark, d)).unionByName(plan.clear_counts(_p(spark, d), keep_merged=False))


def plan_grow(spark, d):
    p = _p(spark, d)
    return plan.grow(p, 2).select("cell_key", "status", F.lit(8).alias("ways")).unionByName(plan.grow(p, 2, diagonal=False).select("cell_key", "status", F.lit(4).alias("ways")))


def _heights(spark, d):
    flat = F.when((F.col("x") + F.col("y")) % 3 == 0, F.lit(0.0)).otherwise((F.col("x") * 7 + F.col("y")) % 50)
    return _covering(spark, d).select("x", "y").distinct().where("(x * 3 + y) % 29 <> 0").select("x", "y", (flat - 0.5).alias("lo"), (flat + F.col("x") % 2 * 0.5).cast("double").alias("hi"))


def ocean_cells(spark, d):
    return plan.ocean_cells(_covering(spark, d), _heights(spark, d))


def plan_trim(spark, d):
    p = _p(spark, d)
    return plan.trim(p, plan.ocean_cells(_covering(spark, d), _heights(spark, d))).select("cell_key", "status")


def plan_resume(spark, d):
    return plan.resume(_p(spark, d)).select("cell_key", "status")


def plan_reset(spark, d):
    return plan.reset(_p(spark, d)).select("cell_key", "status")


def plan_delete(spark, d):
    p = _p(spark, d)
    gone = p.where("rx = 0")
    left, files = plan.delete_cells(p, view(spark, d, "fx_region_file"), gone)
    return left.select("cell_key", F.col("status").alias("what")).unionByName(files.select("cell_key", F.concat(F.lit("file "), F.col("reg_x").cast("string"), F.lit(","), F.col("reg_z").cast("string")).alias("what")))


def master_reset(spark, d):
    return plan.master_reset(_p(spark, d)).select("cell_key", "status")


def set_status(spark, d):
    e = view(spark, d, "fx_cell_event").select("cell_key", "status", "event_id")
    return plan.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "cell_key", "event_id").select("cell_key", "status", "event_id")


def redo_area(spark, d):
    """By a drawn box, and by drawn rings."""
    b, rings = view(spark, d, "fx_cell_box"), view(spark, d, "fx_zone_vertex")
    boxed = plan.redo_area(b, box=(44.93, 24.8, 45.2, 25.25)).select("cell_key", "status", F.lit("box").alias("by"))
    return boxed.unionByName(plan.redo_area(b, rings=rings).select("cell_key", "status", F.lit("rings").alias("by")))


def redo_suspect(spark, d):
    logs = view(spark, d, "fx_log_line").where("line like '%ESA%'").select(F.concat((F.col("cell_id") % 12 - 6).cast("string"), F.lit(",0,4")).alias("cell_key"))
    return plan.redo(_p(spark, d), logs).select("cell_key", "status")


def spiral_order(spark, d):
    return plan.spiral(_p(spark, d))


def sub_world_numbers(spark, d):
    p = _p(spark, d)
    known = p.where("status = 'merged'").select(F.col("cell_key").alias("key"), (F.col("rx") * 100 + F.col("rz") + 5000).cast("long").alias("number"))
    return plan.assign_numbers(known, p.select(F.col("cell_key").alias("key")))


def param_drift(spark, d):
    c = view(spark, d, "customer").select(F.col("c_name").alias("world"), F.lit(0.3).alias("scale"), (45 + (F.col("c_custkey") % 3) * 1e-6).alias("lat"), F.lit(25.0).alias("lon"), (F.col("c_custkey") % 4).alias("merged"))
    return plan.param_drift(c, 0.3, 45.0, 25.0).select("world", "drift")


def project_info(spark, d):
    return plan.project_info(view(spark, d, "fx_cell_event").withColumnRenamed("user_id", "project"), "project")


def world_meta(spark, d):
    meta = writers.world_meta(_p(spark, d), "w", OLAT, OLON, True, {"scale": "0.3", "name": "x"})
    return meta.select("world", F.col("origin.lat").alias("lat"), F.col("origin.locked").alias("locked"), F.element_at("settings", "scale").alias("scale"), F.array_join("merged_cells", ";").alias("merged_cells"))


def owned_regions(spark, d):
    return merge.owned(view(spark, d, "fx_region_file"), _p(spark, d))


def region_owner(spark, d):
    return merge.owner_of(view(spark, d, "fx_region_file"), 4).select("cell_key", "reg_x", "reg_z", "owner_key")


def drift_check(spark, d):
    files = view(spark, d, "fx_region_file")
    moved = files.withColumn("reg_x", F.col("reg_x") + F.when(F.col("cell_key").startswith("1"), 40).otherwise(0))
    return merge.drift_check(moved, _p(spark, d))


def _master(spark, d):
    return view(spark, d, "fx_region_file").where("(reg_x + reg_z) % 3 = 0").select(F.lit("region").alias("sub"), "reg_x", "reg_z")


def collisions(spark, d):
    files = view(spark, d, "fx_region_file").withColumn("sub", F.when(F.col("reg_x") % 2 == 0, "region").otherwise("poi"))
    return merge.collisions(files, _master(spark, d)).select("cell_key", "sub", "reg_x", "reg_z")


def merge_counts(spark, d):
    files = view(spark, d, "fx_region_file").withColumn("sub", F.when(F.col("reg_x") % 2 == 0, "region").otherwise("poi"))
    own = merge.owned(files, _p(spark, d))
    return merge.merge_counts(own, merge.collisions(own.where("own"), _master(spark, d)))


def missing_cells(spark, d):
    return merge.missing_cells(_p(spark, d), view(spark, d, "fx_region_file"))


def worlds(spark, d):
    files = view(spark, d, "fx_region_file").withColumn("length", F.lit(1500000) + F.col("reg_x") * 1000)
    return merge.worlds(_p(spark, d), files)


def world_totals(spark, d):
    p = _p(spark, d).withColumn("w", F.col("rx"))
    files = view(spark, d, "fx_region_file").withColumn("length", F.lit(1500000) + F.col("reg_x") * 1000).join(p.select("cell_key", "w"), "cell_key")
    return merge.world_totals(p, files, "w")


def todo_forced(spark, d):
    return cov.todo(_needed(spark, d), view(spark, d, "fx_cached_tile"), force=True)


def water_share(spark, d):
    e = view(spark, d, "events").select((F.col("user_id") % 20).alias("reg_x"), (F.col("user_id") % 7).alias("reg_z"), F.when(F.col("event_id") % 5 < F.col("user_id") % 4, "minecraft:water").otherwise("minecraft:stone").alias("block"))
    return merge.water_share(e)


QUERIES = {
    f.__name__: f
    for f in (
        coverage_missing, coverage_pct, cells_served, fresh_tiles, cache_info, selection_bbox, outcome_counts, download_groups_depth1,
        download_groups, group_state, import_new, pack_list, plan_add, plan_remove, plan_toggle, plan_clear, plan_grow, ocean_cells,
        plan_trim, plan_resume, plan_reset, plan_delete, master_reset, set_status, redo_area, redo_suspect, spiral_order,
        sub_world_numbers, param_drift, project_info, world_meta, owned_regions, region_owner, drift_check, collisions, merge_counts,
        missing_cells, worlds, water_share, import_counts, world_totals, todo_forced,
    )
}

from tessera.queries.coords import _tx, _ty  # noqa: E402
from tessera.queries.rasters import _inside  # noqa: E402

_COVER = f"(SELECT cell_key, 11 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT *, unnest(range({_ty('north', 11)}, {_ty('south', 11)} + 1)) AS y FROM (SELECT *, unnest(range({_tx('west', 11)}, {_tx('east', 11)} + 1)) AS x FROM fx_cell_box) a) b)"
_AREA = "(SELECT DISTINCT rx + 3 AS rx, rz - 2 AS rz, size, concat(CAST(rx + 3 AS VARCHAR), ',', CAST(rz - 2 AS VARCHAR), ',', CAST(size AS VARCHAR)) AS cell_key FROM fx_plan)"
_HEIGHT = f"(SELECT x, y, f - 0.5 AS lo, f + x % 2 * 0.5 AS hi FROM (SELECT DISTINCT x, y, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE (x * 7 + y) % 50 END AS f FROM {_COVER} c WHERE (x * 3 + y) % 29 <> 0) h)"
_OCEAN = f"(SELECT cell_key FROM {_COVER} c LEFT JOIN {_HEIGHT} h ON h.x = c.x AND h.y = c.y GROUP BY cell_key HAVING bool_and(coalesce(hi <= 1.0 AND lo >= -5.0 AND hi - lo <= 1.5, FALSE)))"
_SERVED = f"(SELECT cell_key, bool_and(t.x IS NOT NULL) AS served, count(*) AS tiles FROM {_COVER} c LEFT JOIN fx_cached_tile t ON t.x = c.x AND t.y = c.y GROUP BY cell_key)"
_GRP = "(SELECT cell_key, CASE WHEN NOT big THEN '' ELSE CAST(CAST(rx >= mx AS INT) + 2 * CAST(rz >= mz AS INT) AS VARCHAR) END AS grp FROM fx_cell_box CROSS JOIN (SELECT floor((min(rx) + max(rx) + 1) / 2.0) AS mx, floor((min(rz) + max(rz) + 1) / 2.0) AS mz, count(*) > 1 AS big FROM fx_cell_box) g)"
_FILES = "(SELECT f.*, CASE WHEN reg_x % 2 = 0 THEN 'region' ELSE 'poi' END AS sub, f.reg_x BETWEEN p.rx * p.size AND p.rx * p.size + p.size - 1 AND f.reg_z BETWEEN -p.rz * p.size - p.size AND -p.rz * p.size - 1 AS own FROM fx_region_file f JOIN fx_plan p ON p.cell_key = f.cell_key)"
_MASTER = "(SELECT DISTINCT 'region' AS sub, reg_x, reg_z FROM fx_region_file WHERE (reg_x + reg_z) % 3 = 0)"
_HIT = "EXISTS (SELECT 1 FROM " + _MASTER + " m WHERE m.sub = f.sub AND m.reg_x = f.reg_x AND m.reg_z = f.reg_z)"
_PCT = "CASE WHEN count(*) = 0 THEN 100.0 ELSE round(100.0 * count(t.x) / CAST(count(*) AS DOUBLE), 1) END"

SQL = {
    "coverage_missing": "SELECT DISTINCT 11 AS z, x, y FROM fx_node_tile n WHERE NOT EXISTS (SELECT 1 FROM fx_cached_tile t WHERE t.x = n.x AND t.y = n.y)",
    "coverage_pct": f"WITH n AS (SELECT DISTINCT x, y, x % 7 AS band FROM fx_node_tile) SELECT count(*) AS total, count(t.x) AS cached, {_PCT} AS pct, band FROM n LEFT JOIN fx_cached_tile t ON t.x = n.x AND t.y = n.y GROUP BY band UNION ALL SELECT count(*), count(t.x), {_PCT}, -1 FROM n LEFT JOIN fx_cached_tile t ON t.x = n.x AND t.y = n.y",
    "cells_served": f"SELECT * FROM {_SERVED} s",
    "fresh_tiles": "SELECT event_id, event_id % 9000 > 2 AND user_id % 60 < 30 AND event_id % 11 <> 0 AS fresh, event_id % 9000 < 67 AS junk, event_id % 9000 <= 4096 AS maybe_hole FROM events",
    "cache_info": "SELECT event_type AS kind, count(*) AS files, round(sum(event_id % 9000) / 1048576.0, 1) AS mb FROM events GROUP BY event_type",
    "selection_bbox": "SELECT status, round(min(south), 6) AS south, round(min(west), 6) AS west, round(max(north), 6) AS north, round(max(east), 6) AS east FROM fx_cell_box GROUP BY status",
    "outcome_counts": "SELECT event_type, count(*) FILTER (o = 'ok') AS ok, count(*) FILTER (o = 'absent') AS absent, count(*) FILTER (o = 'fail') AS fail FROM (SELECT event_type, CASE WHEN event_id % 5 IN (1, 3) THEN 'absent' WHEN event_id % 5 = 2 OR event_id % 200 < 67 THEN 'fail' ELSE 'ok' END AS o FROM events) t GROUP BY event_type",
    "download_groups_depth1": f"SELECT * FROM {_GRP} g",
    "group_state": f"SELECT g.grp, count(*) AS n_cells, count(*) FILTER (s.served) AS n_served, CASE WHEN count(*) FILTER (s.served) = 0 THEN 'failed' WHEN any_value(d.n) > 0 THEN 'done' ELSE 'cached' END AS state FROM {_GRP} g JOIN {_SERVED} s ON s.cell_key = g.cell_key LEFT JOIN (SELECT g.grp, count(*) FILTER (t.x % 5 = 0) AS n FROM {_GRP} g JOIN {_COVER} c ON c.cell_key = g.cell_key JOIN fx_cached_tile t ON t.x = c.x AND t.y = c.y GROUP BY g.grp) d ON d.grp = g.grp GROUP BY g.grp",
    "import_new": "SELECT z, x, y FROM fx_tile_level WHERE NOT has_data",
    "import_counts": "SELECT z, count(*) AS incoming, count(*) FILTER (NOT has_data) AS added, count(*) FILTER (has_data) AS skipped FROM fx_tile_level GROUP BY z",
    "todo_forced": "SELECT DISTINCT 11 AS z, x, y FROM fx_node_tile",
    "world_totals": "SELECT p.w, p.cells, p.merged, coalesce(f.n, 0) AS regions, round(coalesce(f.b, 0) / 1048576.0, 1) AS mb FROM (SELECT rx AS w, count(*) AS cells, count(*) FILTER (status = 'merged') AS merged FROM fx_plan GROUP BY rx) p LEFT JOIN (SELECT p.rx AS w, count(*) AS n, sum(1500000 + reg_x * 1000) AS b FROM fx_region_file f JOIN fx_plan p ON p.cell_key = f.cell_key GROUP BY p.rx) f ON f.w = p.w",
    "pack_list": f"SELECT region_id, zone, total, cached, pct FROM (SELECT zone, count(*) AS total, count(t.x) AS cached, {_PCT} AS pct, substr(sha1(printf('%.4f,%.4f,%.4f,%.4f|%s', any_value(south), any_value(west), any_value(north), any_value(east), lower(zone))), 1, 16) AS region_id FROM (SELECT *, unnest(range({_ty('north', 11)}, {_ty('south', 11)} + 1)) AS y FROM (SELECT *, unnest(range({_tx('west', 11)}, {_tx('east', 11)} + 1)) AS x FROM (SELECT zone, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM fx_zone_vertex GROUP BY zone) p) a) b LEFT JOIN fx_cached_tile t ON t.x = b.x AND t.y = b.y GROUP BY zone) q",
    "plan_add": f"SELECT cell_key, status FROM fx_plan UNION ALL SELECT cell_key, 'planned' FROM {_AREA} a WHERE cell_key NOT IN (SELECT cell_key FROM fx_plan)",
    "plan_remove": f"SELECT cell_key, status FROM fx_plan WHERE status = 'merged' OR cell_key NOT IN (SELECT cell_key FROM {_AREA} a)",
    "plan_toggle": f"SELECT cell_key, rx, rz, status FROM fx_plan WHERE status = 'merged' OR cell_key NOT IN (SELECT cell_key FROM {_AREA} a) UNION ALL SELECT cell_key, rx, rz, 'planned' FROM {_AREA} b WHERE cell_key NOT IN (SELECT cell_key FROM fx_plan)",
    "plan_clear": "SELECT count(*) FILTER (status <> 'merged') AS removed, count(*) FILTER (status = 'merged') AS kept FROM fx_plan UNION ALL SELECT count(*), 0 FROM fx_plan",
    "plan_grow": "SELECT DISTINCT concat(CAST(c.rx + a.i AS VARCHAR), ',', CAST(c.rz + b.i AS VARCHAR), ',4') AS cell_key, coalesce(q.status, 'planned') AS status, w.i AS ways FROM fx_plan c CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) a(i) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) b(i) CROSS JOIN (VALUES (8), (4)) w(i) LEFT JOIN fx_plan q ON q.rx = c.rx + a.i AND q.rz = c.rz + b.i WHERE w.i = 8 OR abs(a.i) + abs(b.i) <= 2",
    "ocean_cells": f"SELECT * FROM {_OCEAN} o",
    "plan_trim": f"SELECT cell_key, status FROM fx_plan WHERE status NOT IN ('planned', 'queued') OR cell_key NOT IN (SELECT cell_key FROM {_OCEAN} o)",
    "plan_resume": "SELECT cell_key, status FROM fx_plan WHERE status <> 'merged'",
    "plan_reset": "SELECT cell_key, CASE WHEN status IN ('queued', 'running') THEN 'planned' ELSE status END AS status FROM fx_plan",
    "plan_delete": "SELECT cell_key, CASE WHEN rx = 0 THEN 'planned' ELSE status END AS what FROM fx_plan UNION ALL SELECT cell_key, concat('file ', CAST(reg_x AS VARCHAR), ',', CAST(reg_z AS VARCHAR)) FROM fx_region_file f WHERE NOT EXISTS (SELECT 1 FROM fx_plan p WHERE p.rx = 0 AND f.reg_x BETWEEN p.rx * p.size AND p.rx * p.size + p.size - 1 AND f.reg_z BETWEEN -p.rz * p.size - p.size AND -p.rz * p.size - 1)",
    "master_reset": "SELECT cell_key, CASE WHEN status = 'merged' THEN 'planned' ELSE status END AS status FROM fx_plan",
    "set_status": "SELECT cell_key, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM fx_cell_event GROUP BY cell_key",
    "redo_area": f"SELECT cell_key, status, 'box' AS by FROM fx_cell_box WHERE (south + north) / 2 BETWEEN 44.93 AND 45.2 AND (west + east) / 2 BETWEEN 24.8 AND 25.25 UNION ALL SELECT cell_key, status, 'rings' FROM fx_cell_box SEMI JOIN {_inside('(SELECT cell_key, (south + north) / 2 AS lat, (west + east) / 2 AS lon FROM fx_cell_box)', 'cell_key')} i USING (cell_key)",
    "redo_suspect": "SELECT cell_key, status FROM fx_plan WHERE cell_key IN (SELECT concat(CAST(cell_id % 12 - 6 AS VARCHAR), ',0,4') FROM fx_log_line WHERE line LIKE '%ESA%')",
    "spiral_order": "SELECT cell_key, row_number() OVER (ORDER BY greatest(abs(rx - cx), abs(rz - cz)), atan2(rz - cz, rx - cx), cell_key) AS place FROM fx_plan CROSS JOIN (SELECT avg(rx) AS cx, avg(rz) AS cz FROM fx_plan) m",
    "sub_world_numbers": "SELECT cell_key AS key, CAST(CASE WHEN status = 'merged' THEN rx * 100 + rz + 5000 ELSE m + row_number() OVER (PARTITION BY status = 'merged' ORDER BY cell_key) END AS BIGINT) AS number FROM fx_plan CROSS JOIN (SELECT max(rx * 100 + rz + 5000) AS m FROM fx_plan WHERE status = 'merged') t",
    "param_drift": "SELECT c_name AS world, c_custkey % 4 > 0 AND c_custkey % 3 = 2 AS drift FROM customer",
    "project_info": "SELECT user_id AS project, count(DISTINCT cell_key) AS cells, count(*) FILTER (status = 'merged') AS merged FROM fx_cell_event GROUP BY user_id",
    "world_meta": "SELECT 'w' AS world, CAST(45.0 AS DOUBLE) AS lat, TRUE AS locked, '0.3' AS scale, coalesce(string_agg(cell_key, ';' ORDER BY cell_key) FILTER (status = 'merged'), '') AS merged_cells FROM fx_plan",
    "owned_regions": f"SELECT cell_key, reg_x, reg_z, own FROM {_FILES} f",
    "region_owner": "SELECT cell_key, reg_x, reg_z, concat(CAST(CAST(floor(reg_x / 4.0) AS BIGINT) AS VARCHAR), ',', CAST(CAST(-floor(reg_z / 4.0) - 1 AS BIGINT) AS VARCHAR), ',4') AS owner_key FROM fx_region_file",
    "drift_check": "SELECT p.cell_key, CASE WHEN x0 IS NULL THEN 'empty' WHEN x1 < p.rx * p.size - 2 OR x0 > p.rx * p.size + p.size + 1 OR z1 < -p.rz * p.size - p.size - 2 OR z0 > -p.rz * p.size + 1 THEN 'drift' ELSE 'ok' END AS \"check\" FROM fx_plan p LEFT JOIN (SELECT cell_key, min(rx1) AS x0, max(rx1) AS x1, min(reg_z) AS z0, max(reg_z) AS z1 FROM (SELECT *, reg_x + CASE WHEN cell_key LIKE '1%' THEN 40 ELSE 0 END AS rx1 FROM fx_region_file) m GROUP BY cell_key) f ON f.cell_key = p.cell_key",
    "collisions": f"SELECT cell_key, sub, reg_x, reg_z FROM {_FILES} f WHERE {_HIT}",
    "merge_counts": f"SELECT cell_key, count(*) FILTER (own) AS copied, count(*) FILTER (NOT own) AS skipped, count(*) FILTER (own AND {_HIT}) AS collisions, coalesce(string_agg(DISTINCT sub, ',' ORDER BY sub) FILTER (own), '') AS subs FROM {_FILES} f GROUP BY cell_key".replace(_HIT, "hit").replace(f"FROM {_FILES} f", f"FROM (SELECT f.*, {_HIT} AS hit FROM {_FILES} f) f"),
    "missing_cells": "SELECT DISTINCT cell_key FROM (SELECT cell_key, rx * 4 + a.i AS x, -rz * 4 - 4 + b.i AS z FROM fx_plan CROSS JOIN (VALUES (0), (1), (2), (3)) a(i) CROSS JOIN (VALUES (0), (1), (2), (3)) b(i) WHERE status = 'merged') w WHERE NOT EXISTS (SELECT 1 FROM fx_region_file f WHERE f.reg_x = w.x AND f.reg_z = w.z)",
    "worlds": "SELECT p.cell_key, p.status, f.n IS NOT NULL AS has_source, coalesce(f.n, 0) AS regions, round(coalesce(f.b, 0) / 1048576.0, 1) AS mb FROM fx_plan p LEFT JOIN (SELECT cell_key, count(*) AS n, sum(1500000 + reg_x * 1000) AS b FROM fx_region_file GROUP BY cell_key) f ON f.cell_key = p.cell_key",
    "water_share": "SELECT user_id % 20 AS reg_x, user_id % 7 AS reg_z, round(avg(CASE WHEN event_id % 5 < user_id % 4 THEN 100.0 ELSE 0.0 END), 6) AS pct, round(avg(CASE WHEN event_id % 5 < user_id % 4 THEN 100.0 ELSE 0.0 END), 6) > 35.0 AS wet FROM events GROUP BY 1, 2",
}
