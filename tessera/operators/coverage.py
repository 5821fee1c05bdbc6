"""Which tiles a selection needs, which are there, and what follows: coverage, groups, ledgers, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.generate import SIDES
from tessera.operators.lineage import cut

TILE = ["z", "x", "y"]
# Least bytes of an elevation and a map tile, most bytes of a uniform one, days that a tile stays fresh.
LEAST_ELEVATION, LEAST_MAP, MOST_UNIFORM, FRESH_DAYS = 67, 12, 4096, 30
DEFAULT_BUDGET_KM2, MAX_DEPTH = 30000.0, 6


def missing_tiles(needed: DataFrame, cached: DataFrame) -> DataFrame:
    return needed.select(*TILE).distinct().join(cached, TILE, "left_anti")


def todo(needed: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Work list: all needed tiles when forced, else the missing ones."""
    return needed.select(*TILE).distinct() if force else missing_tiles(needed, cached)


def coverage(needed: DataFrame, cached: DataFrame, *by: str) -> DataFrame:
    """total, cached and pct (1 decimal; 100 for none needed), over all or per group."""
    have = cached.select(*TILE).distinct().withColumn("have", F.lit(1))
    joined = needed.select(*by, *TILE).distinct().join(have, TILE, "left")
    counted = joined.groupBy(*by).agg(F.count("*").alias("total"), F.count("have").alias("cached"))
    pct = F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("cached") / F.col("total"), 1))
    return counted.withColumn("pct", pct)


def cells_served(covering: DataFrame, tiles: DataFrame) -> DataFrame:
    """``covering(cell_key, z, x, y)`` against ``tiles(z, x, y, ok)``: a cell is served iff all its tiles are ok."""
    joined = covering.join(tiles.select(*TILE, "ok"), TILE, "left")
    return joined.groupBy("cell_key").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("served"), F.count("*").alias("tiles"))


def is_fresh(size, age_days, tail) -> Column:
    """A tile file is fresh: more than 2 bytes, younger than 30 days, and its text ends in a brace."""
    return (geo.col(size) > 2) & (geo.col(age_days) < FRESH_DAYS) & F.rtrim(geo.col(tail), F.lit(" \t\n\x0b\x0c\r")).endswith("}")


def is_junk(size) -> Column:
    return geo.col(size) < LEAST_ELEVATION


def maybe_hole(size) -> Column:
    return geo.col(size) <= MOST_UNIFORM


def union_bbox(boxes: DataFrame, *by: str) -> DataFrame:
    ends = {"south": F.min, "west": F.min, "north": F.max, "east": F.max}
    return boxes.groupBy(*by).agg(*[ends[s](s).alias(s) for s in SIDES])


def outcome_counts(ledger: DataFrame, outcomes: tuple[str, ...], *by: str) -> DataFrame:
    return ledger.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])


def group_state(served: DataFrame, tiles: DataFrame) -> DataFrame:
    """State per group: ``served(grp, served)`` and ``tiles(grp, state)``: failed if no cell is served, done if any tile was fetched, else cached."""
    cells = served.groupBy("grp").agg(F.count_if("served").alias("n_served"), F.count("*").alias("n_cells"))
    fetched = tiles.groupBy("grp").agg(F.count_if(F.col("state") == "done").alias("n_done"))
    state = F.when(F.col("n_served") == 0, "failed").when(F.coalesce("n_done", F.lit(0)) > 0, "done").otherwise("cached")
    return cells.join(fetched, "grp", "left").select("grp", "n_cells", "n_served", state.alias("state"))


def plan_groups(cells: DataFrame, budget_km2: float | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Area-budget quadtree over ``cells(cell_key, rx, rz, south, west, north, east)``: adds grp, a path of quadrant digits.

    A group splits at the middle indices of its cells while it has more than one, its depth is
    below the limit and the box around it is larger than the budget. Each level is one aggregate by
    group, of at most 4 ** level rows, and goes on with the cells of groups that split alone, which
    the shared folder keeps, so no level is computed again; at most ``max_depth`` levels.
    """
    if budget_km2 is None:
        whole = union_bbox(cells).select(geo.area_km2({s: F.col(s) for s in SIDES}).alias("km2")).first()["km2"]
        budget_km2 = min(whole or DEFAULT_BUDGET_KM2, DEFAULT_BUDGET_KM2)
    frontier = cells.withColumn("grp", F.lit(""))
    done = []
    for depth in range(max_depth):
        facts = frontier.groupBy("grp").agg(
            F.count("*").alias("n"), F.floor((F.min("rx") + F.max("rx") + 1) / 2).alias("mx"), F.floor((F.min("rz") + F.max("rz") + 1) / 2).alias("mz"),
            *[(F.min if s in ("south", "west") else F.max)(s).alias(f"u_{s}") for s in SIDES],
        )
        area = geo.area_km2({s: F.col(f"u_{s}") for s in SIDES})
        splits = ((F.col("n") > 1) & (area > budget_km2)).alias("splits")
        digit = ((F.col("rx") >= F.col("mx")).cast("int") + 2 * (F.col("rz") >= F.col("mz")).cast("int")).cast("string")
        joined = frontier.join(F.broadcast(facts.select("grp", "mx", "mz", splits)), "grp")  # at most 4 ** depth rows
        level = cut(joined.select(*cells.columns, F.when(F.col("splits"), F.concat("grp", digit)).otherwise(F.col("grp")).alias("grp"), "splits"))
        done.append(level.where("not splits").drop("splits"))
        frontier = level.where("splits").drop("splits")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, frontier])


def preview_groups(grouped: DataFrame, margin_m: float = 0.0) -> DataFrame:
    """Per group its id, box with margin and member cells in order."""
    boxes = grouped.groupBy("grp").agg(
        *[(F.min if s in ("south", "west") else F.max)(s).alias(s) for s in SIDES],
        F.array_join(F.sort_array(F.collect_list("cell_key")), ";").alias("cells"), F.count("*").alias("n_cells"),
    )
    lat, lon = geo.margin_degrees(margin_m, (F.col("south") + F.col("north")) / 2)
    grown = geo.grow_bbox({s: F.col(s) for s in SIDES}, lat, lon)
    return boxes.select("grp", geo.bbox_key(grown, "groups").alias("id"), "n_cells", "cells", *[c.alias(s) for s, c in grown.items()])


def import_new(incoming: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, the first of repeated ones; nothing is overwritten."""
    first = Window.partitionBy(*key).orderBy(*[c for c in incoming.columns if c not in key] or key)
    fresh = incoming.join(existing.select(*key).distinct(), list(key), "left_anti")
    return fresh.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")


def import_counts(incoming: DataFrame, existing: DataFrame, kind: str, *key: str) -> DataFrame:
    """Per ``kind`` of ``incoming``: how many keys came, how many are new and how many were there."""
    have = existing.select(*key).distinct().withColumn("have", F.lit(1))
    met = incoming.select(*dict.fromkeys([kind, *key])).distinct().join(have, list(key), "left")
    return met.groupBy(kind).agg(F.count("*").alias("incoming"), F.count_if(F.col("have").isNull()).alias("added"), F.count("have").alias("skipped"))


def cache_info(catalogue: DataFrame) -> DataFrame:
    """Files and megabytes (1 decimal) per kind of ``catalogue(kind, length)``."""
    return catalogue.groupBy("kind").agg(F.count("*").alias("files"), F.round(F.sum("length") / 1048576.0, 1).alias("mb"))


def fresh_only(catalogue: DataFrame) -> DataFrame:
    """Tiles ``(z, x, y)`` of ``catalogue(z, x, y, size, age_days, tail)`` whose files can be used as they are."""
    return catalogue.where(is_fresh("size", "age_days", "tail")).select(*TILE).distinct()
