"""Elevation rasters: a tile is one row ``(z, x, y, h)``, h its heights row by row. Only whole tiles are shuffled, never pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.coverage import LEAST_ELEVATION, maybe_hole
from tessera.operators.generate import ancestors
from tessera.operators.lineage import cut

# Offset of the encoding, what counts as no data, the sane band, the least height of tile ranges.
OFFSET, NO_DATA, LOWEST, HIGHEST, RANGE_FLOOR = 32768.0, -32000.0, -500.0, 9000.0, -1000.0


def decode(red: Column, green: Column, blue: Column) -> Column:
    return red * 256.0 + green + blue / 256.0 - OFFSET


def encode(h: Column) -> dict[str, Column]:
    e = F.greatest(F.lit(0.0), F.least(F.lit(65535.99), h + OFFSET))
    whole = F.floor(e)
    return {"red": F.floor(whole / 256) % 256, "green": whole % 256, "blue": F.floor((e - whole) * 256)}


def valid(h: Column) -> Column:
    return h.between(LOWEST, HIGHEST)


def strided(h: str | Column, width: int, k: int) -> Column:
    """Every ``k``-th pixel of every ``k``-th row."""
    return F.filter(h, lambda v, i: (F.floor(i / width) % k == 0) & (i % width % k == 0))


def is_hole(h: str | Column, width: int, k: int = 1) -> Column:
    return F.forall(strided(h, width, k), lambda v: v <= NO_DATA)


def tile_range(tiles: DataFrame) -> DataFrame:
    """lo and hi of each tile without samples of -1000 m or less; null if none is left."""
    kept = F.filter("h", lambda v: v > RANGE_FLOOR)
    return tiles.select("z", "x", "y", F.array_min(kept).alias("lo"), F.array_max(kept).alias("hi"))


def tenths(x: Column) -> Column:
    """``x`` to one decimal, halves of its tenfold away from zero: :func:`F.round` goes by the shortest decimal of ``x`` instead, on the other side where that is just below a half."""
    return F.round(x * 10) / 10


def tile_info(tiles: DataFrame, width: int, k: int = 8) -> DataFrame:
    """min, max and mean of the strided samples (1 decimal), and whether the tile is flat (spread below 2 m)."""
    s = tiles.withColumn("s", strided("h", width, k))
    total = F.aggregate("s", F.lit(0.0), lambda a, v: a + v)
    lo, hi = F.array_min("s"), F.array_max("s")
    return s.select("z", "x", "y", tenths(lo).alias("min_m"), tenths(hi).alias("max_m"), tenths(total / F.size("s")).alias("mean_m"), (hi - lo < 2).alias("flat"))


def survey(tiles: DataFrame, width: int, k: int = 8, *by: str) -> DataFrame:
    """min and max of sane strided samples (1 decimal), tiles with any, and whether there were any, over all or per group."""
    sane = F.filter(strided("h", width, k), valid)
    per = tiles.select(*by, F.array_min(sane).alias("lo"), F.array_max(sane).alias("hi"))
    return per.groupBy(*by).agg(
        tenths(F.min("lo")).alias("min_m"), tenths(F.max("hi")).alias("max_m"), F.count("lo").alias("tiles"), (F.count("lo") > 0).alias("ok")
    )


def deepest_parent(holes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Holes ``(z, x, y)`` with the deepest ancestor ``(zp, xp, yp)`` among ``tiles(z, x, y)`` that hold data; holes without one are left out."""
    have = tiles.select(F.col("z").alias("zp"), F.col("x").alias("xp"), F.col("y").alias("yp")).distinct()
    met = ancestors(holes.select("z", "x", "y")).join(have, ["zp", "xp", "yp"])
    return met.groupBy("z", "x", "y").agg(F.max_by(F.struct("zp", "xp", "yp"), "zp").alias("p")).select("z", "x", "y", "p.*")


def pixels(tiles: DataFrame, width: int) -> DataFrame:
    """Tiles as rows ``(z, x, y, px, py, h)``, for reports on single pixels; a tile without heights has none."""
    # outer: else Spark tests the size of the array first, below the projection that makes it, and makes it again for each pixel
    at = tiles.select("z", "x", "y", F.posexplode_outer("h").alias("at", "h")).where("at is not null")
    return at.select("z", "x", "y", (F.col("at") % width).alias("px"), F.floor(F.col("at") / width).cast("int").alias("py"), "h")


def _every_pixel(width: int, value) -> Column:
    """An array of ``value(px, py)`` row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), lambda p: value(p % width, F.floor(p / width).cast("int")))


def _at(h: str, x: Column, y: Column, width: int) -> Column:
    return F.get(F.col(h), (y * width + x).cast("int"))


def overzoom(matches: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """Tiles ``(z, x, y, h)`` from their parents' sub-squares: bilinear, half-pixel centres, clamped at the square's edge.

    ``matches(z, x, y, zp, xp, yp)`` meet the parents among ``tiles(z, x, y, h)`` by an equi-join; a
    row carries one parent tile.
    """
    parents = tiles.select(F.col("z").alias("zp"), F.col("x").alias("xp"), F.col("y").alias("yp"), F.col("h").alias("parent"))
    scale = F.expr("shiftleft(1, z - zp)")
    met = (
        matches.join(parents, ["zp", "xp", "yp"])
        .withColumn("sub", (F.lit(width) / scale).cast("int"))
        .withColumn("ox", ((F.col("x") - F.col("xp") * scale) * F.col("sub")).cast("int"))
        .withColumn("oy", ((F.col("y") - F.col("yp") * scale) * F.col("sub")).cast("int"))
    )
    # per pixel of a line: the two pixels of the parent that it lies between, and the share of the second
    place = lambda p: F.greatest(F.lit(0.0), F.least(F.col("sub") - 1.0, (p + 0.5) * F.col("sub") / width - 0.5))
    line = F.transform(
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), place),
        lambda s: F.struct(F.floor(s).cast("int").alias("low"), F.least(F.floor(s) + 1, F.col("sub") - 1).cast("int").alias("high"), (s - F.floor(s)).alias("share")),
    )

    def value(px: Column, py: Column) -> Column:
        a, b = F.get("line", px), F.get("line", py)
        h = lambda x, y: _at("parent", F.col("ox") + x, F.col("oy") + y, width)
        upper = (1 - a["share"]) * h(a["low"], b["low"]) + a["share"] * h(a["high"], b["low"])
        lower = (1 - a["share"]) * h(a["low"], b["high"]) + a["share"] * h(a["high"], b["high"])
        return (1 - b["share"]) * upper + b["share"] * lower

    return met.withColumn("line", line).select("z", "x", "y", _every_pixel(width, value).alias("h"))


def judged(tiles: DataFrame, width: int) -> DataFrame:
    """``tiles(z, x, y, h[, length])`` with ``state``: absent (a file too short to be an image), hole or ok.

    A file above the size that a uniform tile compresses to is ok without a look at its pixels.
    """
    hole = F.when(is_hole("h", width), "hole").otherwise("ok")
    if "length" not in tiles.columns:
        return tiles.withColumn("state", hole)
    return tiles.withColumn("state", F.when(F.col("length") < LEAST_ELEVATION, "absent").when(~maybe_hole("length"), "ok").otherwise(hole))


def repair(tiles: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """``tiles(z, x, y, h[, length])`` as ``(z, x, y, h, outcome)``: fixed holes have their heights from the deepest of ``parents`` with data.

    Outcomes: ok, absent, fixed, unfixable (no parent has data).
    """
    known = judged(tiles, width)
    match = deepest_parent(known.where("state = 'hole'"), parents)
    fixed = overzoom(match, parents, width).withColumnRenamed("h", "fixed")
    outcome = F.when(F.col("state") != "hole", F.col("state")).when(F.col("fixed").isNotNull(), "fixed").otherwise("unfixable")
    return known.join(fixed, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("fixed", "h").alias("h"), outcome.alias("outcome"))


def repair_counts(repaired: DataFrame, *by: str) -> DataFrame:
    """How many tiles of :func:`repair` were checked, and how each came out."""
    kinds = ("ok", "fixed", "unfixable", "absent")
    return repaired.groupBy(*by).agg(F.count("*").alias("checked"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def grey(h: Column, lo: Column, hi: Column) -> Column:
    span = F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (h - lo) / span * 255.0))


def hillshade(tiles: DataFrame, lo: float, hi: float, width: int) -> DataFrame:
    """Shaded grey 0-255 per pixel, ``(z, x, y, grey)``: central differences inside a tile, one-sided ones at its edges."""

    def slope(before: Column, after: Column, steps: Column) -> Column:
        return F.when(steps == 0, 0.0).otherwise((after - before) / steps)

    def value(px: Column, py: Column) -> Column:
        left, right = F.greatest(px - 1, F.lit(0)), F.least(px + 1, F.lit(width - 1))
        up, down = F.greatest(py - 1, F.lit(0)), F.least(py + 1, F.lit(width - 1))
        dx = slope(_at("h", left, py, width), _at("h", right, py, width), right - left)
        dy = slope(_at("h", px, up, width), _at("h", px, down, width), down - up)
        shade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 + 0.36 * (dx + dy)))
        shaded = grey(_at("h", px, py, width), F.lit(lo), F.lit(hi)) * (0.5 + 0.5 * shade)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), shaded))).cast("int")

    return tiles.select("z", "x", "y", _every_pixel(width, value).alias("grey"))


def downsample(tiles: DataFrame, width: int, k: int = 2) -> DataFrame:
    """``k`` x ``k`` tiles into one: means of the valid pixels of each square; null where there is none. z falls by log2 k.

    One shuffle, in which a parent collects its ``k * k`` children at most.
    """
    up = k.bit_length() - 1
    child = (F.col("x") % k + F.col("y") % k * k).cast("int")
    grouped = tiles.groupBy((F.col("z") - up).alias("z"), F.shiftright("x", up).alias("x"), F.shiftright("y", up).alias("y")).agg(
        F.map_from_entries(F.collect_list(F.struct(child.alias("child"), "h"))).alias("children")
    )

    def value(px: Column, py: Column) -> Column:
        def sample(i: int, j: int) -> Column:
            sx, sy = px * k + i, py * k + j
            held = F.element_at("children", (F.floor(sx / width) + F.floor(sy / width) * k).cast("int"))
            return F.get(held, ((sy % width) * width + sx % width).cast("int"))

        valid_ones = F.filter(F.array(*[sample(i, j) for j in range(k) for i in range(k)]), lambda h: h > NO_DATA)
        return F.aggregate(valid_ones, F.lit(0.0), lambda total, h: total + h) / F.nullif(F.size(valid_ones), F.lit(0))

    return grouped.select("z", "x", "y", _every_pixel(width, value).alias("h"))


def pyramid(tiles: DataFrame, width: int, levels: int) -> DataFrame:
    """All levels: the tiles and ``levels`` repeated downsamplings, each written to the shared folder and made from the one before."""
    out = level = tiles.select("z", "x", "y", "h")
    for _ in range(levels):
        level = cut(downsample(level, width))
        out = out.unionByName(level)
    return out


def overview(tiles: DataFrame, k: int) -> DataFrame:
    """Mean height per tile ``k`` levels up over its full grid of children; ``tiles(x, y, mean_m)``; missing ones counted."""
    side = 1 << k
    tops = tiles.select(F.shiftright("x", k).alias("tx"), F.shiftright("y", k).alias("ty")).distinct()
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    full = tops.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("tx", "ty", (F.col("tx") * side + F.col("i")).alias("x"), (F.col("ty") * side + F.col("j")).alias("y"))
    met = full.join(tiles.select("x", "y", "mean_m"), ["x", "y"], "left")
    return met.groupBy("tx", "ty").agg(F.avg("mean_m").alias("mean_m"), F.count_if(F.col("mean_m").isNull()).alias("missing"))


def upsample(tiles: DataFrame, data: DataFrame, zoom: int, width: int) -> DataFrame:
    """Tiles ``(z, x, y)`` below the ``zoom`` of ``data(z, x, y, h)``: crops of their ancestors there, resampled as in :func:`overzoom`."""
    shift = lambda c: F.expr(f"shiftright({c}, z - {zoom})")
    match = tiles.where(F.col("z") > zoom).select("z", "x", "y", F.lit(zoom).alias("zp"), shift("x").alias("xp"), shift("y").alias("yp"))
    return overzoom(match, data, width)
