"""Queries of the tile bake."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.fixtures import view
from tessera.operators import osm

TARGET = "(x + y) % 2 = 0"


def _parts(spark, d):
    nodes = view(spark, d, "fx_node_tile")
    refs = view(spark, d, "fx_way_ref")
    members = view(spark, d, "fx_rel_member")
    targets = nodes.select("x", "y").distinct().where(TARGET)
    return nodes, refs, members, targets


def osm_home_tiles(spark, d):
    return osm.home_tiles(view(spark, d, "fx_node")).select("id", "x", "y", "tag_name")


def osm_pruned_nodes(spark, d):
    nodes, _, _, targets = _parts(spark, d)
    return osm.prune_by_targets(nodes, targets).join(targets, ["x", "y"], "left_semi").select("id", "x", "y")


def osm_way_locations(spark, d):
    nodes, refs, _, _ = _parts(spark, d)
    return osm.way_locations(refs, nodes)


def osm_way_tiles(spark, d):
    nodes, refs, _, targets = _parts(spark, d)
    return osm.way_tiles(osm.way_locations(refs, nodes), targets)


def osm_foreign_nodes(spark, d):
    nodes, refs, _, targets = _parts(spark, d)
    located = osm.way_locations(refs, nodes)
    return osm.foreign_nodes(located, osm.way_tiles(located, targets))


def osm_relation_tiles(spark, d):
    nodes, refs, members, targets = _parts(spark, d)
    return osm.relation_tiles(members, osm.way_tiles(osm.way_locations(refs, nodes), targets), nodes, targets)


def osm_seam_merge(spark, d):
    nodes = view(spark, d, "fx_node_tile")
    copies = nodes.select("x", "y", "id", F.lit("b").alias("source")).unionByName(
        nodes.where("id % 3 = 0").select("x", "y", "id", F.lit("a").alias("source"))
    )
    return osm.merge_copies(copies, "x", "y", "id")


def osm_empty_tiles(spark, d):
    """Of all tiles of the box around the nodes, and of one more to each side, those without a node."""
    nodes, _, _, _ = _parts(spark, d)
    box = nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    across = box.select("*", F.explode(F.sequence(F.col("low_x") - 1, F.col("high_x") + 1)).alias("x"))
    return osm.with_empty(across.select("x", F.explode(F.sequence(F.col("low_y") - 1, F.col("high_y") + 1)).alias("y")), nodes)


def osm_bake_counts(spark, d):
    nodes, refs, members, targets = _parts(spark, d)
    return osm.bake_counts(targets, osm.elements(nodes, refs, members, targets))


def osm_bake_total(spark, d):
    """The account of a bake: some targets are cached already, and some writes failed."""
    nodes, refs, members, targets = _parts(spark, d)
    cached = view(spark, d, "fx_cached_tile")
    todo = targets.join(cached.select("x", "y"), ["x", "y"], "left_anti")
    counts = osm.bake_counts(todo, osm.elements(nodes, refs, members, todo))
    return osm.bake_summary(targets, cached, counts, todo.where("(x * 7 + y) % 31 <> 0"))


def osm_source_prune(spark, d):
    """Sources (suppliers' boxes; every tenth unknown) that can hold a target tile."""
    s = view(spark, d, "fx_zone_vertex").groupBy("zone_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    s = s.select("zone_id", *[F.when(F.col("zone_id") % 10 != 0, F.col(c)).alias(c) for c in ("south", "west", "north", "east")])
    return osm.prune_sources(s, _parts(spark, d)[3]).select("zone_id", F.col("south").isNull().alias("unknown"))


QUERIES = {
    f.__name__: f
    for f in (
        osm_home_tiles, osm_pruned_nodes, osm_way_locations, osm_way_tiles, osm_foreign_nodes, osm_relation_tiles, osm_seam_merge,
        osm_empty_tiles, osm_bake_counts, osm_bake_total, osm_source_prune,
    )
}

_TARGET = f"(SELECT DISTINCT x, y FROM fx_node_tile WHERE {TARGET})"
_LOC = "(SELECT w.way_id, w.seq, w.ref, n.lon, n.lat, n.x, n.y FROM fx_way_ref w LEFT JOIN fx_node_tile n ON n.id = w.ref)"
_EMIT = f"(SELECT DISTINCT way_id, x, y FROM {_LOC} l WHERE x IS NOT NULL AND {TARGET})"
_FOREIGN = f"(SELECT DISTINCT e.x, e.y, l.ref, l.lon, l.lat FROM {_EMIT} e JOIN {_LOC} l ON l.way_id = e.way_id WHERE l.x IS NOT NULL AND (l.x <> e.x OR l.y <> e.y))"
_REL = f"(SELECT DISTINCT m.rel_id, e.x, e.y FROM fx_rel_member m JOIN {_EMIT} e ON m.member_type = 'way' AND m.ref = e.way_id)"
_COUNTS = f"""(SELECT t.x, t.y, CAST(count(*) FILTER (kind = 'node') AS BIGINT) AS n_node, CAST(count(*) FILTER (kind = 'foreign') AS BIGINT) AS n_foreign,
 CAST(count(*) FILTER (kind = 'way') AS BIGINT) AS n_way, CAST(count(*) FILTER (kind = 'relation') AS BIGINT) AS n_relation, count(kind) = 0 AS empty
 FROM {_TARGET} t LEFT JOIN (SELECT x, y, 'node' AS kind FROM fx_node_tile UNION ALL SELECT x, y, 'foreign' FROM {_FOREIGN} f
 UNION ALL SELECT x, y, 'way' FROM {_EMIT} e UNION ALL SELECT x, y, 'relation' FROM {_REL} r) k ON k.x = t.x AND k.y = t.y GROUP BY t.x, t.y)"""

SQL = {
    "osm_home_tiles": "SELECT n.id, t.x, t.y, n.tag_name FROM fx_node n JOIN fx_node_tile t ON t.id = n.id",
    "osm_pruned_nodes": f"SELECT id, x, y FROM fx_node_tile WHERE {TARGET}",
    "osm_way_locations": f"SELECT * FROM {_LOC} l",
    "osm_way_tiles": f"SELECT * FROM {_EMIT} e",
    "osm_foreign_nodes": f"SELECT * FROM {_FOREIGN} f",
    "osm_relation_tiles": f"SELECT * FROM {_REL} r",
    "osm_seam_merge": "SELECT x, y, id, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source FROM fx_node_tile",
    "osm_empty_tiles": "SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT x, unnest(range(y0 - 1, y1 + 2)) AS y FROM (SELECT y0, y1, unnest(range(x0 - 1, x1 + 2)) AS x FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_node_tile) b) a) t WHERE NOT EXISTS (SELECT 1 FROM fx_node_tile n WHERE n.x = t.x AND n.y = t.y)",
    "osm_bake_counts": f"SELECT * FROM {_COUNTS} c",
    "osm_bake_total": f"""SELECT (SELECT count(*) FROM {_TARGET} t) AS total, (SELECT count(*) FROM {_TARGET} t SEMI JOIN fx_cached_tile c ON c.x = t.x AND c.y = t.y) AS skip,
 count(*) FILTER (ok AND NOT empty) AS baked, count(*) FILTER (ok AND empty) AS empty, count(*) FILTER (NOT ok) AS fail, CAST(coalesce(sum(n_node + n_foreign + n_way + n_relation) FILTER (ok), 0) AS BIGINT) AS elements
 FROM (SELECT *, (x * 7 + y) % 31 <> 0 AS ok FROM {_COUNTS} k WHERE NOT EXISTS (SELECT 1 FROM fx_cached_tile c WHERE c.x = k.x AND c.y = k.y)) q""",
    "osm_source_prune": f"""SELECT zone_id, zone_id % 10 = 0 AS unknown FROM (SELECT zone_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM fx_zone_vertex GROUP BY zone_id) z
 CROSS JOIN (SELECT min(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 2048.0))))) AS a, max(degrees(atan(sinh(pi() * (1 - 2 * y / 2048.0))))) AS b, min(x / 2048.0 * 360.0 - 180.0) AS c, max((x + 1) / 2048.0 * 360.0 - 180.0) AS f FROM {_TARGET} t) o
 WHERE zone_id % 10 = 0 OR (n >= a AND s <= b AND e >= c AND w <= f)""",
}
