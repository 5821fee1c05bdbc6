"""Sinks: element tiles, manifests, ring points, reports, world snapshots, owned regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.lineage import cut, exists, small


#: Halvings of the grid that a folder stands for: folders hold blocks of 2^n x 2^n tiles. Regions of a side of a master's folder.
BLOCK_LEVELS, MASTER_SIDE = 4, 32


def write_tiles(elements: DataFrame, path: str, files: int | None = None, levels: int = BLOCK_LEVELS) -> None:
    """``elements(z, x, y, type, id, ...)`` as Parquet along a space-filling curve: near tiles lie in the same few files.

    Rows are dealt by ranges of (z, place on the curve, id), so a dense tile is split like any
    other rows, and sorted along the curve, so that row groups hold small boxes. Folders are blocks
    of ``2^levels`` x ``2^levels`` tiles; :func:`read_tiles` opens those that a box touches.
    ``files`` is the number of ranges, by default that of the session's shuffles.
    """
    curve = geo.z_order("x", "y")
    placed = elements.withColumn("curve", curve).withColumn("block", F.shiftright("curve", 2 * levels))
    ranged = placed.repartitionByRange(files, "z", "curve", "id") if files else placed.repartitionByRange("z", "curve", "id")
    ranged.sortWithinPartitions("z", "curve", "type", "id").write.mode("overwrite").partitionBy("z", "block").parquet(path)


def read_tiles(spark: SparkSession, path: str, z: int, west: int, north: int, east: int, south: int, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Elements of :func:`write_tiles` in the tiles x from ``west`` to ``east`` and y from ``north`` to ``south``.

    Only folders of blocks that the box touches are listed and read; inside, row groups are skipped
    by their place on the curve and by x and y.
    """
    sides = [(v >> levels, w >> levels) for v, w in ((west, east), (north, south))]
    (bx0, bx1), (by0, by1) = sides
    low, high = geo.z_order_of(west, north), geo.z_order_of(east, south)  # the curve rises with x and y
    whole = spark.read.parquet(path).where((F.col("z") == z) & F.col("block").between(low >> 2 * levels, high >> 2 * levels))
    if (bx1 - bx0 + 1) * (by1 - by0 + 1) <= 1000:
        whole = whole.where(F.col("block").isin([geo.z_order_of(i, j) for i in range(bx0, bx1 + 1) for j in range(by0, by1 + 1)]))
    return whole.where(F.col("curve").between(low, high) & F.col("x").between(west, east) & F.col("y").between(north, south)).drop("curve", "block")


def tile_json(elements: DataFrame, generator: str) -> DataFrame:
    """One JSON document per tile, elements by type and id. A tile is one file by contract, so it is one group."""
    element = F.struct(*[c for c in elements.columns if c not in ("z", "x", "y")])
    grouped = elements.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(F.struct("type", "id", element.alias("e")))).alias("es"))
    doc = F.struct(F.lit(0.6).alias("version"), F.lit(generator).alias("generator"), F.transform("es", lambda e: e["e"]).alias("elements"))
    return grouped.select("z", "x", "y", F.to_json(doc).alias("value"))


def write_manifest(packs: DataFrame, path: str, per_file: int = 1000) -> None:
    """Manifests ``(region_id, name, bbox, zoom, elevation, osm)`` with the time of writing, as JSON files of arrays of about ``per_file`` of them.

    With ``per_file=1`` each has a file of its own, which many packs make slow to commit, list and read.
    """
    dated = packs.withColumn("updated", F.unix_timestamp())
    if per_file == 1:
        dated.write.mode("append").option("maxRecordsPerFile", 1).json(path)
        return
    held = cut(dated)
    files = max(1, -(-held.count() // per_file))
    groups = held.groupBy(F.pmod(F.xxhash64("region_id"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(F.struct(*dated.columns))).alias("value"))
    groups.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)


def write_points(rings: DataFrame, path: str) -> None:
    """Ring points ``(zone, seq, x, z, lon, lat)`` as CSV folders by zone, degrees with 6 decimals."""
    six = lambda c: F.format_string("%.6f", F.col(c)).alias(c)
    rows = rings.select("zone", "seq", F.col("x").cast("long"), F.col("z").cast("long"), six("lon"), six("lat"))
    rows.repartition("zone").sortWithinPartitions("zone", "seq").drop("seq").write.mode("overwrite").partitionBy("zone").csv(path, header=True)


def run_report(summary: DataFrame, cells: DataFrame, timeline: DataFrame, lanes: DataFrame, most: int = 200) -> DataFrame:
    """One nested row: summary, its ``most`` worst cells, newest 360 buckets, and worker lanes of those cells."""
    from tessera.operators import runs

    worst = runs.top_cells(cells, most)
    top = worst.agg(F.array_sort(F.collect_list(F.struct("place", "cell_key", "status"))).alias("cells"))
    line = runs.newest(timeline, 360, "t").agg(F.array_sort(F.collect_list(F.struct(*timeline.columns))).alias("timeline"))
    bars = lanes.join(worst.select("cell_key"), "cell_key", "left_semi").agg(F.array_sort(F.collect_list(F.struct("lane", "from", "to", "cell_key"))).alias("lanes"))
    return summary.select(F.struct(*summary.columns).alias("summary")).join(top).join(line).join(bars)  # one row each


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def world_meta(plan: DataFrame, world: str, lat: float, lon: float, locked: bool, settings: dict[str, str]) -> DataFrame:
    """One row: name, origin, settings and the sorted merged cells."""
    merged = F.sort_array(F.collect_list(F.when(F.col("status") == "merged", F.col("cell_key"))))
    kept = F.create_map(*[F.lit(x) for pair in sorted(settings.items()) for x in pair]) if settings else F.create_map().cast("map<string,string>")
    origin = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(locked).alias("locked"))
    return plan.agg(merged.alias("merged_cells")).select(F.lit(world).alias("world"), origin.alias("origin"), kept.alias("settings"), "merged_cells")


def merge_owned(regions: DataFrame, path: str, side: int = MASTER_SIDE) -> None:
    """Rows ``([sub,] reg_x, reg_z, ...)`` replace exactly the regions they belong to (of their sub-folder); all others stay.

    Regions lie in folders of ``side`` x ``side`` of them. Folders that the rows touch are written
    anew, with what stays; the new content is in the shared folder first, so a lost executor or a
    failed write can be repeated.
    """
    spark = regions.sparkSession
    keys = [c for c in ("sub", "reg_x", "reg_z") if c in regions.columns]
    folder = [F.floor(F.col(c) / side).cast("int").alias(f"folder_{c[-1]}") for c in ("reg_x", "reg_z")]
    names = ["folder_x", "folder_z"]
    new = regions.select("*", *folder)
    if exists(spark, path):
        held = spark.read.parquet(path).select(*new.columns)
        touched = small(new.select(*names).distinct())
        new = new.unionByName(held.join(touched, names, "left_semi").join(new.select(*keys).distinct(), keys, "left_anti"))
    writer = cut(new).repartition(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*names).parquet(path)
