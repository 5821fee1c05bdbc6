"""Plan algebra: tables ``(cell_key, rx, rz, size, status)`` with one row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.ordering import global_rank

PLAN = ["cell_key", "rx", "rz", "size", "status"]
KEY = ["cell_key"]


def add(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """New cells become planned; known ones keep their status."""
    fresh = cells.select(*PLAN[:-1]).distinct().join(plan, KEY, "left_anti").withColumn("status", F.lit("planned"))
    return plan.select(*PLAN).unionByName(fresh.select(*PLAN))


def remove(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """Without the given cells; merged ones stay."""
    gone = cells.select(F.col("cell_key").alias("gone_key")).distinct()
    out = plan.join(gone, F.col("cell_key") == F.col("gone_key"), "left")
    return out.where(F.col("gone_key").isNull() | (F.col("status") == "merged")).select(*PLAN)


def toggle(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """Given cells that are there go (unless merged), others come as planned."""
    asked = cells.select(*[F.col(c).alias(f"n_{c}") for c in PLAN[:-1]]).distinct()
    both = plan.join(asked, F.col("cell_key") == F.col("n_cell_key"), "full_outer")
    stays = F.col("n_cell_key").isNull() | F.col("cell_key").isNull() | (F.col("status") == "merged")
    fill = [F.coalesce(c, f"n_{c}").alias(c) for c in PLAN[:-1]]
    return both.where(stays).select(*fill, F.coalesce("status", F.lit("planned")).alias("status"))


def clear(plan: DataFrame, keep_merged: bool = True) -> DataFrame:
    return plan.where("status = 'merged'") if keep_merged else plan.where(F.lit(False))


def grow(plan: DataFrame, rings: int, diagonal: bool = True) -> DataFrame:
    """``rings`` rings of planned cells around all cells, in one step: all offsets of that distance, less what is there."""
    near = [(dx, dz) for dx in range(-rings, rings + 1) for dz in range(-rings, rings + 1) if diagonal or abs(dx) + abs(dz) <= rings]
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx, dz in near]))
    moved = plan.select("rx", "rz", "size", steps.alias("s")).select((F.col("rx") + F.col("s.dx")).alias("rx"), (F.col("rz") + F.col("s.dz")).alias("rz"), "size")
    return add(plan, moved.distinct().withColumn("cell_key", geo.cell_key("rx", "rz", "size")))


def ocean_cells(covering: DataFrame, heights: DataFrame) -> DataFrame:
    """Open water: ``covering(cell_key, x, y)`` all known in ``heights(x, y, lo, hi)``, at most 1 m, at least -5 m and flat to 1.5 m."""
    flat = (F.col("hi") <= 1.0) & (F.col("lo") >= -5.0) & (F.col("hi") - F.col("lo") <= 1.5)
    joined = covering.select("cell_key", "x", "y").join(heights, ["x", "y"], "left")
    return joined.groupBy("cell_key").agg(F.bool_and(F.coalesce(flat, F.lit(False))).alias("ocean")).where("ocean").select("cell_key")


def trim(plan: DataFrame, ocean: DataFrame) -> DataFrame:
    """Without open water among planned and queued cells."""
    wet = ocean.select(F.col("cell_key").alias("wet_key")).distinct()
    out = plan.join(wet, F.col("cell_key") == F.col("wet_key"), "left")
    return out.where(F.col("wet_key").isNull() | ~F.col("status").isin("planned", "queued")).select(*PLAN)


def resume(plan: DataFrame, force: bool = False) -> DataFrame:
    """Cells to run: all that aren't merged, or all when forced."""
    return plan if force else plan.where("status <> 'merged'")


def reset(plan: DataFrame) -> DataFrame:
    """After a restart: queued and running cells are planned again."""
    return plan.withColumn("status", F.when(F.col("status").isin("queued", "running"), "planned").otherwise(F.col("status")))


def delete_cells(plan: DataFrame, regions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with the cells ``gone(cell_key)`` planned again, and ``regions(reg_x, reg_z, ...)`` without theirs."""
    from tessera.operators.generate import regions_of

    keys = gone.select("cell_key").distinct()
    theirs = regions_of(plan.join(keys, KEY, "left_semi")).select("reg_x", "reg_z").distinct()
    marked = plan.join(keys.withColumn("hit", F.lit(True)), KEY, "left")
    status = F.when(F.col("hit"), "planned").otherwise(F.col("status"))
    return marked.withColumn("status", status).select(*PLAN), regions.join(theirs, ["reg_x", "reg_z"], "left_anti")


def master_reset(plan: DataFrame) -> DataFrame:
    return plan.withColumn("status", F.when(F.col("status") == "merged", "planned").otherwise(F.col("status")))


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version of each row by ``key``; of equal versions the change."""
    both = state.withColumn("is_change", F.lit(0)).unionByName(changes.withColumn("is_change", F.lit(1)))
    columns = state.columns
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "is_change")).alias("row")).select("row.*")


def spiral(cells: DataFrame) -> DataFrame:
    """Centre-out order: place (from 1) by ring around the mean, then angle.

    A global order needs global ranks; rows carry keys only.
    """
    mean = cells.agg(F.avg("rx").alias("cx"), F.avg("rz").alias("cz"))
    both = cells.join(F.broadcast(mean))  # one row
    dx, dz = F.col("rx") - F.col("cx"), F.col("rz") - F.col("cz")
    ringed = both.select("cell_key", F.greatest(F.abs(dx), F.abs(dz)).alias("ring"), F.atan2(dz, dx).alias("angle"))
    return global_rank(ringed, "place", "ring", "angle", "cell_key").select("cell_key", "place")


def assign_numbers(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """``known(key, number)`` with numbers for new keys of ``fresh(key)``: from the largest on, in order of key."""
    new = fresh.select("key").distinct().join(known, "key", "left_anti")
    top = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top"))
    numbered = global_rank(new, "place", "key").join(F.broadcast(top)).select("key", (F.col("top") + F.col("place")).alias("number"))
    return known.select("key", "number").unionByName(numbered)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive."""
    return lat.between(south, north) & lon.between(west, east)


def clear_counts(plan: DataFrame, keep_merged: bool = True) -> DataFrame:
    """One row: how many cells :func:`clear` removes and keeps."""
    left = clear(plan, keep_merged).agg(F.count("*").alias("kept"))
    return plan.agg(F.count("*").alias("all")).join(left).select((F.col("all") - F.col("kept")).alias("removed"), "kept")  # one row each


def centres(boxes: DataFrame) -> DataFrame:
    """Cells ``(..., south, west, north, east)`` with lat and lon of their middle."""
    return boxes.withColumn("lat", (F.col("south") + F.col("north")) / 2).withColumn("lon", (F.col("west") + F.col("east")) / 2)


def redo_area(boxes: DataFrame, box: tuple[float, float, float, float] | None = None, rings: DataFrame | None = None) -> DataFrame:
    """Cells of ``boxes(cell_key, status, south, ...)`` whose centre is in any of ``rings(zone_id, seq, lon, lat)``, or without rings in ``box`` (south, west, north, east)."""
    from tessera.operators.zones import points_in_zones

    placed = centres(boxes)
    if rings is not None:
        return points_in_zones(placed, rings).select(*boxes.columns).distinct()
    south, west, north, east = box
    return placed.where(in_box(F.col("lat"), F.col("lon"), south, west, north, east)).select(*boxes.columns)


def project_info(plans: DataFrame, *by: str) -> DataFrame:
    """Cells and merged cells per project ``by`` of ``plans(cell_key, status)``."""
    return plans.groupBy(*by).agg(F.count_distinct("cell_key").alias("cells"), F.count_if(F.col("status") == "merged").alias("merged"))


def size_estimate(plan: DataFrame, *by: str) -> DataFrame:
    """Regions and expected megabytes of the cells."""
    sums = plan.groupBy(*by).agg(F.sum(geo.regions_in("size")).cast("long").alias("regions"))
    return sums.withColumn("mb", geo.megabytes_of("regions").cast("long"))


def redo(plan: DataFrame, keys: DataFrame) -> DataFrame:
    """Cells of the plan among ``keys(cell_key)`` (suspects or an explicit list)."""
    return plan.join(keys.select("cell_key").distinct(), KEY, "left_semi")


def param_drift(meta: DataFrame, scale: float, olat: float, olon: float) -> DataFrame:
    """Merged worlds ``meta(world, scale, lat, lon, merged)`` whose parameters differ from the current ones."""
    off = (F.abs(F.col("scale") - scale) > 1e-9) | (F.abs(F.col("lat") - olat) > 1e-6) | (F.abs(F.col("lon") - olon) > 1e-6)
    return meta.withColumn("drift", F.coalesce((F.col("merged") > 0) & off, F.lit(False)))
