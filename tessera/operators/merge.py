"""Merging cells into a master: which regions each owns, drift, collisions, gaps, accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.generate import regions_of

REGION_CHUNKS = 32


def owned(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Region files ``(cell_key, reg_x, reg_z)`` with own: inside the cell's rectangle, else its seam buffer."""
    rect = geo.owned_rectangle("rx", "rz", "size")
    inside = F.col("reg_x").between(rect["rx_min"], rect["rx_max"]) & F.col("reg_z").between(rect["rz_min"], rect["rz_max"])
    return files.join(plan, "cell_key").select(*files.columns, inside.alias("own"))


def owner_of(files: DataFrame, size: int) -> DataFrame:
    """With cells of one size the owner follows from the region itself: an equi-join key instead of a range."""
    rx, rz = F.floor(F.col("reg_x") / size), -F.floor(F.col("reg_z") / size) - 1
    return files.withColumn("owner_key", geo.cell_key(rx, rz, F.lit(size)))


def drift_check(files: DataFrame, plan: DataFrame, buffer_chunks: int = 2) -> DataFrame:
    """Per cell: empty if it has no region, drift if its regions miss the owned rectangle by more than the buffer, else ok."""
    reach = -(-max(0, buffer_chunks) // REGION_CHUNKS) + 1
    ends = files.groupBy("cell_key").agg(F.min("reg_x").alias("x0"), F.max("reg_x").alias("x1"), F.min("reg_z").alias("z0"), F.max("reg_z").alias("z1"))
    rect = geo.owned_rectangle("rx", "rz", "size")
    misses = (F.col("x1") < rect["rx_min"] - reach) | (F.col("x0") > rect["rx_max"] + reach) | (F.col("z1") < rect["rz_min"] - reach) | (F.col("z0") > rect["rz_max"] + reach)
    reason = F.when(F.col("x0").isNull(), "empty").when(misses, "drift").otherwise("ok")
    return plan.join(ends, "cell_key", "left").select("cell_key", reason.alias("check"))


def collisions(incoming: DataFrame, master: DataFrame) -> DataFrame:
    """Incoming files that the master already has."""
    return incoming.join(master.select("sub", "reg_x", "reg_z").distinct(), ["sub", "reg_x", "reg_z"], "left_semi")


def merge_counts(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Per cell: regions copied and skipped, collisions, sub-folders merged; ``files`` carry sub and own."""
    counts = files.groupBy("cell_key").agg(
        F.count_if("own").alias("copied"), F.count_if(~F.col("own")).alias("skipped"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("own"), F.col("sub")))), ",").alias("subs"),
    )
    hit = hits.groupBy("cell_key").agg(F.count("*").alias("collisions"))
    return counts.join(hit, "cell_key", "left").select("cell_key", "copied", "skipped", F.coalesce("collisions", F.lit(0)).cast("long").alias("collisions"), "subs")


def missing_regions(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Regions that merged cells own and the world doesn't have."""
    wanted = regions_of(plan.where("status = 'merged'")).select("cell_key", "reg_x", "reg_z")
    return wanted.join(files.select("reg_x", "reg_z").distinct(), ["reg_x", "reg_z"], "left_anti").select("cell_key", "reg_x", "reg_z")


def missing_cells(plan: DataFrame, files: DataFrame) -> DataFrame:
    return missing_regions(plan, files).select("cell_key").distinct()


def water_share(surface: DataFrame, limit: float = 35.0) -> DataFrame:
    """Share of water columns per region of ``surface(reg_x, reg_z, block)``, and whether it is above ``limit`` percent."""
    share = F.avg(F.when(F.col("block") == "minecraft:water", 100.0).otherwise(0.0))
    return surface.groupBy("reg_x", "reg_z").agg(F.round(share, 6).alias("pct")).withColumn("wet", F.col("pct") > limit)


def world_totals(plan: DataFrame, files: DataFrame, *by: str) -> DataFrame:
    """Per world ``by``, a column of ``plan`` and ``files``: its cells, merged cells, regions and megabytes."""
    cells = plan.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "merged").alias("merged"))
    sizes = files.groupBy(*by).agg(F.count("*").alias("regions"), F.sum("length").alias("bytes"))
    return cells.join(sizes, list(by), "left").select(
        *by, "cells", "merged", F.coalesce("regions", F.lit(0)).cast("long").alias("regions"), F.round(F.coalesce("bytes", F.lit(0)) / 1048576.0, 1).alias("mb")
    )


def worlds(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Per cell its status, whether files exist, and their megabytes (``files`` carry length)."""
    sizes = files.groupBy("cell_key").agg(F.count("*").alias("regions"), F.sum("length").alias("bytes"))
    return plan.join(sizes, "cell_key", "left").select(
        "cell_key", "status", F.col("regions").isNotNull().alias("has_source"), F.coalesce("regions", F.lit(0)).cast("long").alias("regions"),
        F.round(F.coalesce("bytes", F.lit(0)) / 1048576.0, 1).alias("mb"),
    )
