"""Map elements onto tiles: complete ways, foreign nodes, relations, seam merge, empty tiles, counts.

Element tables: nodes ``(id, lon, lat, x, y)`` with their home tile, way references
``(way_id, seq, ref)``, relation members ``(rel_id, member_type, ref, role)``, targets ``(x, y)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.lineage import cut, dealt


def home_tiles(nodes: DataFrame, z: int = 11) -> DataFrame:
    """Nodes with the tile they lie in."""
    return nodes.withColumn("x", geo.tile_x("lon", z)).withColumn("y", geo.tile_y("lat", z))


def prune_by_targets(nodes: DataFrame, targets: DataFrame, z: int = 11) -> DataFrame:
    """Nodes inside the box around all target tiles, as plain ranges of lon and lat that a scan can push down.

    For nodes that are emitted at home only: a complete way needs its nodes outside the box, too.
    """
    ends = targets.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return nodes.where(F.lit(False))
    edge = targets.sparkSession.range(1).select(
        geo.tile_bbox(F.lit(ends[0]), F.lit(ends[3]), z)["south"].alias("s"), geo.tile_bbox(F.lit(ends[0]), F.lit(ends[2]), z)["north"].alias("n"),
        geo.tile_bbox(F.lit(ends[0]), F.lit(0), z)["west"].alias("w"), geo.tile_bbox(F.lit(ends[1]), F.lit(0), z)["east"].alias("e"),
    ).first()
    eps = 1e-9
    return nodes.where(F.col("lat").between(edge["s"] - eps, edge["n"] + eps) & F.col("lon").between(edge["w"] - eps, edge["e"] + eps))


def prune_sources(sources: DataFrame, targets: DataFrame, z: int = 11) -> DataFrame:
    """Of ``sources(..., south, west, north, east)`` those that can hold a target tile; touching counts, and an unknown extent is kept."""
    tile = geo.tile_bbox("x", "y", z)
    need = targets.agg(F.min(tile["south"]).alias("t_south"), F.min(tile["west"]).alias("t_west"), F.max(tile["north"]).alias("t_north"), F.max(tile["east"]).alias("t_east"))
    touches = (F.col("north") >= F.col("t_south")) & (F.col("south") <= F.col("t_north")) & (F.col("east") >= F.col("t_west")) & (F.col("west") <= F.col("t_east"))
    met = sources.join(F.broadcast(need))  # one row
    return met.where(F.col("south").isNull() | touches).select(*sources.columns)


def first_source(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each ``key`` from the first ``source`` that has it: border elements come in several sources."""
    first = F.min("source").over(Window.partitionBy(key))
    return dealt(rows, key).withColumn("first_", first).where(F.col("source") == F.col("first_")).drop("first_")


def way_locations(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each reference of a way with its node's place and home tile, nulls for missing nodes; order kept in seq."""
    place = nodes.select(F.col("id").alias("ref"), "lon", "lat", "x", "y")
    return refs.join(place, "ref", "left").select("way_id", "seq", "ref", "lon", "lat", "x", "y")


def way_tiles(located: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Tiles ``(way_id, x, y)`` that a way touches, target tiles only if given."""
    touched = located.where("x is not null").select("way_id", "x", "y").distinct()
    return touched if targets is None else touched.join(targets.select("x", "y"), ["x", "y"], "left_semi").select("way_id", "x", "y")


def foreign_nodes(located: DataFrame, emitted: DataFrame) -> DataFrame:
    """Nodes ``(x, y, ref, lon, lat)`` that a way emitted to a tile has in other tiles; once per tile."""
    homes = located.where("x is not null").select("way_id", "ref", "lon", "lat", F.col("x").alias("hx"), F.col("y").alias("hy")).distinct()
    return (
        emitted.join(homes, "way_id")
        .where((F.col("x") != F.col("hx")) | (F.col("y") != F.col("hy")))
        .groupBy("x", "y", "ref")
        .agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    )


def relation_tiles(members: DataFrame, emitted: DataFrame, nodes: DataFrame, targets: DataFrame, rows: int | None = None) -> DataFrame:
    """Tiles ``(rel_id, x, y)`` of a relation: of its emitted ways and its nodes; relations inside relations place nothing.

    With ``rows``, about how many there are to meet, both sides are dealt to as many partitions as these need.
    """
    places = emitted.select(F.lit("way").alias("member_type"), F.col("way_id").alias("ref"), "x", "y").unionByName(
        nodes.select(F.lit("node").alias("member_type"), F.col("id").alias("ref"), "x", "y")
    )
    if rows is None:
        met = members.join(places, ["member_type", "ref"])
    else:  # one key, which stays one where all members are of one type
        of = F.struct("member_type", "ref").alias("of")
        held, lying = members.where("member_type is not null and ref is not null").select("rel_id", of), places.select(of, "x", "y")
        met = dealt(held, "of", rows=rows).join(dealt(lying, "of", rows=rows), "of")
    return met.select("rel_id", "x", "y").distinct().join(targets.select("x", "y"), ["x", "y"], "left_semi").select("rel_id", "x", "y")


def merge_copies(copies: DataFrame, *key: str, order: str = "source") -> DataFrame:
    """Of the copies of one element in a tile, the first by source."""
    first = Window.partitionBy(*key).orderBy(order)
    return copies.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")


def elements(nodes: DataFrame, refs: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """All elements of all target tiles: ``(x, y, kind, id)``; foreign nodes are nodes too. The bake as one plan.

    References meet their nodes once; each way is then one row with its places (a way has 2,000
    nodes at most by the map's own rule) per tile that it is emitted to, which the shared folder
    keeps for the three kinds made from it.
    """
    place = F.struct("ref", "x", "y")
    ways = way_locations(refs, nodes).where("x is not null").groupBy("way_id").agg(F.collect_set(place).alias("places"))
    touched = ways.withColumn("tile", F.explode_outer(F.array_distinct(F.transform("places", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))))
    spread = touched.select("way_id", F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), "places")
    emitted = cut(spread.join(targets.select("x", "y"), ["x", "y"], "left_semi").select("way_id", "x", "y", "places"))
    home = nodes.join(targets.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", F.lit("node").alias("kind"), "id")
    away = F.filter("places", lambda p: (p["x"] != F.col("x")) | (p["y"] != F.col("y")))
    met = emitted.select("x", "y", F.explode_outer(F.transform(away, lambda p: p["ref"])).alias("id")).where("id is not null")
    foreign = dealt(met, "x", "y", "id").distinct().select("x", "y", F.lit("foreign").alias("kind"), "id")
    lines = emitted.select("x", "y", F.lit("way").alias("kind"), F.col("way_id").alias("id"))
    relations = relation_tiles(members, emitted.select("way_id", "x", "y"), nodes, targets, emitted.count()).select("x", "y", F.lit("relation").alias("kind"), F.col("rel_id").alias("id"))
    return home.unionByName(foreign).unionByName(lines).unionByName(relations)


def with_empty(targets: DataFrame, tiles: DataFrame) -> DataFrame:
    """Targets that have no element."""
    return targets.select("x", "y").join(tiles.select("x", "y").distinct(), ["x", "y"], "left_anti")


def bake_counts(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Per target tile the number of elements of each kind, and whether it is empty."""
    kinds = ("node", "foreign", "way", "relation")
    counts = found.groupBy("x", "y").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds]
    return targets.select("x", "y").join(counts, ["x", "y"], "left").select("x", "y", *zero, F.col("n_node").isNull().alias("empty"))


def bake_summary(targets: DataFrame, cached: DataFrame, counts: DataFrame, written: DataFrame) -> DataFrame:
    """One row: target tiles in all, skipped as cached, baked, empty, failed (in :func:`bake_counts` but not ``written(x, y)``), and elements."""
    have = cached.select("x", "y").distinct()
    skip = targets.select("x", "y").distinct().join(have, ["x", "y"], "left_semi").agg(F.count("*").alias("skip"))
    total = targets.select("x", "y").distinct().agg(F.count("*").alias("total"))
    there = F.col("there").isNotNull()
    done = counts.join(written.select("x", "y", F.lit(True).alias("there")).distinct(), ["x", "y"], "left").agg(
        F.count_if(there & ~F.col("empty")).alias("baked"), F.count_if(there & F.col("empty")).alias("empty"), F.count_if(~there).alias("fail"),
        F.coalesce(F.sum(F.when(there, F.col("n_node") + F.col("n_foreign") + F.col("n_way") + F.col("n_relation"))), F.lit(0)).alias("elements"),
    )
    return total.join(skip).join(done)  # one row each
