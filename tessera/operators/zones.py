"""Points against zones: rays, distance bands, shared borders, priorities; ring simplification.

Rings are tables ``(zone_id, seq, lon, lat)``. Points meet a cover of the rings first, in cells as
large as the rings' edges allow (an equi-join), then the edges of their cell; distances are taken to
the segments of the few boxes that can hold the nearest one.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.generate import edges
from tessera.operators.lineage import cut


def crosses(lat: Column, lon: Column, edge: Column) -> Column:
    """Whether a ray from the point crosses the edge (lat, lon) - (lat2, lon2)."""
    yi, xi, yj, xj = edge["lat2"], edge["lon2"], edge["lat"], edge["lon"]
    return ((yi > lat) != (yj > lat)) & (lon < (xj - xi) * (lat - yi) / (yj - yi + 1e-18) + xi)


def usable_edges(vertices: DataFrame) -> DataFrame:
    """Edges ``(zone_id, lat, lon, lat2, lon2)`` of rings of three points or more, with ``mean_edge``, the ring's mean length of edge in degrees."""
    whole = Window.partitionBy("zone_id")
    length = F.greatest(F.abs(F.col("lat2") - F.col("lat")), F.abs(F.col("lon2") - F.col("lon")))
    around = edges(vertices, "zone_id").withColumn("points", F.count("*").over(whole)).withColumn("mean_edge", F.avg(length).over(whole))
    return around.where("points >= 3").select("zone_id", "lat", "lon", "lat2", "lon2", "mean_edge")


def rings(vertices: DataFrame) -> DataFrame:
    """Zones with usable rings: ``(zone_id, south, west, north, east)``."""
    return usable_edges(vertices).groupBy("zone_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


#: Cell sizes in degrees that a ring's cover is made of; a ring has the smallest that is as wide as its mean edge, or the largest.
CELL_SIZES = (4.0, 1.0, 1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024, 1 / 4096)
#: Cells of a row that runs of inner cells are cut at, as a power of two, and room for rounding in what an edge touches, in cells.
RUN_BITS, TOUCH = 10, 1e-6
#: Where the grid starts, in cells: off round numbers, so that no vertex is on a line of it.
START = 0.27182818284590454


def cell_of(c: Column) -> Column:
    return F.floor(c / F.col("size") + START)


def line_at(g: Column) -> Column:
    """The western or southern line of cells ``g``."""
    return (g - START) * F.col("size")


def _at_latitude(lat: Column) -> Column:
    """Where an edge is at a latitude, as :func:`crosses` has it."""
    return (F.col("lon") - F.col("lon2")) * (lat - F.col("lat2")) / (F.col("lat") - F.col("lat2") + 1e-18) + F.col("lon2")


def ring_cover(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings as cells: border cells with the edges that touch them, and runs of inner cells, which no edge touches.

    The first table has a row per edge and border cell ``(zone_id, size, gx, gy, ref_lat, ref_lon,
    ref_in, edge)``, with the middle of the cell's eastern line and whether it is inside; the second has runs
    ``(zone_id, size, gy, block, first, last)`` of cells that are inside whole, cut at blocks of a row.
    Cells are as small as the ring's edges ask for, so the rows of both are about as many as the
    vertices, however large the ring is.
    """
    size = F.lit(CELL_SIZES[0])
    for smaller in CELL_SIZES[1:]:
        size = F.when(F.col("mean_edge") <= smaller, smaller).otherwise(size)
    sized = usable_edges(vertices).withColumn("size", size)
    low, high = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    room = F.col("size") * TOUCH
    rows = cut(sized.withColumn("gy", F.explode(F.sequence(cell_of(low - room), cell_of(high + room)))))  # read three times
    ends = [F.least(high, F.greatest(low, v)) for v in (line_at(F.col("gy")) - room, line_at(F.col("gy") + 1) + room)]
    west, east = F.least("lon", "lon2"), F.greatest("lon", "lon2")
    places = [F.when(high - low < room, v).otherwise(_at_latitude(end)) for v, end in zip((west, east), ends, strict=True)]
    span = [F.greatest(west, F.least(*places)) - room, F.least(east, F.greatest(*places)) + room]
    edge = F.struct("lat", "lon", "lat2", "lon2").alias("edge")
    touched = rows.withColumn("gx", F.explode(F.sequence(cell_of(span[0]), cell_of(span[1])))).select("zone_id", "size", "gx", "gy", edge)

    # whether the middles of border cells' eastern lines are inside: by the crossings east of them on the middle line of their row of cells
    middle, eastern = line_at(F.col("gy") + 0.5), line_at(F.col("gx") + 1)
    crossings = rows.where((F.col("lat2") > middle) != (F.col("lat") > middle)).select("zone_id", "size", "gy", _at_latitude(middle).alias("at"), F.lit(None).cast("long").alias("gx"), F.lit(1).alias("crossing"))
    border = touched.select("zone_id", "size", "gx", "gy").distinct()
    asked = border.select("zone_id", "size", "gy", eastern.alias("at"), "gx", F.lit(0).alias("crossing"))
    from_east = Window.partitionBy("zone_id", "size", "gy").orderBy(F.desc("at"), "crossing")
    known = asked.unionByName(crossings).withColumn("ref_in", F.sum("crossing").over(from_east.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    # the next border cell to the east: the last one before in this order
    known = known.withColumn("next", F.last("gx", ignorenulls=True).over(from_east.rowsBetween(Window.unboundedPreceding, -1))).where("crossing = 0")
    known = cut(known)

    refs = known.select("zone_id", "size", "gx", "gy", middle.alias("ref_lat"), F.col("at").alias("ref_lon"), "ref_in")
    edged = touched.join(refs, ["zone_id", "size", "gx", "gy"])
    runs = known.where("ref_in and next > gx + 1").withColumn("gx", F.col("gx") + 1)
    blocks = runs.withColumn("block", F.explode(F.sequence(F.shiftright("gx", RUN_BITS), F.shiftright(F.col("next") - 1, RUN_BITS))))
    first, last = F.shiftleft("block", RUN_BITS), F.shiftleft(F.col("block") + 1, RUN_BITS) - 1
    inner = blocks.select("zone_id", "size", "gy", "block", F.greatest("gx", first).alias("first"), F.least(F.col("next") - 1, last).alias("last"))
    return edged, inner


def points_in_zones(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs ``(point columns, zone_id)`` of points ``(lat, lon)`` inside a zone's ring (holes aren't subtracted).

    Places, each once however many points stand on it, meet the rings' covers (:func:`ring_cover`)
    on their cell of every cell size. A place in an inner cell is inside. In a border cell, the way
    east to the cell's edge and along it to the reference point is followed: the place is inside if
    that point is, but for each edge that the way crosses.
    """
    edged, inner = ring_cover(vertices)
    sizes = F.explode(F.array(*[F.lit(c) for c in CELL_SIZES])).alias("size")
    places = points.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).distinct().select("p_lat", "p_lon", sizes)
    placed = places.select("p_lat", "p_lon", "size", cell_of(F.col("p_lon")).alias("gx"), cell_of(F.col("p_lat")).alias("gy"))
    met = placed.join(edged, ["size", "gx", "gy"]).select("p_lat", "p_lon", "zone_id", "ref_lat", "ref_lon", "ref_in", "edge.*")
    east = crosses(F.col("p_lat"), F.col("p_lon"), F.struct("lat", "lon", "lat2", "lon2")) & (_at_latitude(F.col("p_lat")) <= F.col("ref_lon"))
    passed = F.col("lat2") + (F.col("ref_lon") - F.col("lon2")) * (F.col("lat") - F.col("lat2")) / (F.col("lon") - F.col("lon2"))
    along = F.when((F.col("lon") > F.col("ref_lon")) != (F.col("lon2") > F.col("ref_lon")), (passed > F.col("p_lat")) != (passed > F.col("ref_lat"))).otherwise(False)
    near = met.groupBy("p_lat", "p_lon", "zone_id").agg(F.count_if(east != along).alias("crossed"), F.first("ref_in").alias("ref_in"))
    border = near.where((F.col("crossed") % 2 == 1) != F.col("ref_in")).select(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "zone_id")
    within = placed.withColumn("block", F.shiftright("gx", RUN_BITS)).join(inner, ["size", "gy", "block"]).where("gx between first and last").select(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "zone_id")
    return points.join(border.unionByName(within), ["lat", "lon"]).select(*points.columns, "zone_id")


def segment_distance(x: Column, z: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    dx, dz = x2 - x1, z2 - z1
    long2 = dx * dx + dz * dz
    t = F.when(long2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (z - z1) * dz) / long2)))
    return F.sqrt(F.pow(x - x1 - t * dx, F.lit(2.0)) + F.pow(z - z1 - t * dz, F.lit(2.0)))


def _block_edges(vertices: DataFrame, olat: float, olon: float, scale: float) -> DataFrame:
    e = edges(vertices, "zone_id")
    at = lambda lon, lat, n: [geo.block_xf(lon, olat, olon, scale).alias(f"x{n}"), geo.block_zf(lat, olat, scale).alias(f"z{n}")]
    return e.select("zone_id", *at("lon", "lat", 1), *at("lon2", "lat2", 2))


def _near(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Points ``(x, z)`` with the segments within ``reach`` blocks, through a grid of squares; adds distance and zone_id."""
    grid = max(reach, 1.0)
    ends = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / grid), F.floor((F.greatest(a, b) + reach) / grid))
    spread = segments.withColumn("gx", F.explode(ends("x1", "x2"))).withColumn("gz", F.explode(ends("z1", "z2")))
    placed = points.withColumn("gx", F.floor(F.col("x") / grid)).withColumn("gz", F.floor(F.col("z") / grid))
    distance = segment_distance(*[F.col(c) for c in ("x", "z", "x1", "z1", "x2", "z2")])
    return placed.join(spread, ["gx", "gz"]).withColumn("distance", distance).where(F.col("distance") <= reach)


#: Parts of the reach that segments are gathered in.
PARTS = 16


def nearest(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Points ``(point_id, x, z)`` with the distance to their nearest segment, as far as one is within ``reach`` blocks.

    Segments are gathered by the square that their middle is in, a sixteenth of the reach wide, and
    the squares' boxes meet the points first. Of the boxes near a point only those go on that can
    hold something as near as the farthest corner of the best one; their segments are compared.
    """
    part = max(reach, 1.0) / PARTS
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / part)
    gathered = segments.select("x1", "z1", "x2", "z2", at("x1", "x2").alias("sx"), at("z1", "z2").alias("sz"))
    sides = {"left": F.min(F.least("x1", "x2")), "right": F.max(F.greatest("x1", "x2")), "low": F.min(F.least("z1", "z2")), "high": F.max(F.greatest("z1", "z2"))}
    boxes = gathered.groupBy("sx", "sz").agg(*[v.alias(k) for k, v in sides.items()])
    grid = max(reach, 1.0)
    ends = lambda a, b: F.sequence(F.floor((F.col(a) - reach) / grid), F.floor((F.col(b) + reach) / grid))
    spread = boxes.withColumn("gx", F.explode(ends("left", "right"))).withColumn("gz", F.explode(ends("low", "high")))
    placed = points.withColumn("gx", F.floor(F.col("x") / grid)).withColumn("gz", F.floor(F.col("z") / grid))
    outside = lambda v, a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(v), F.col(v) - F.col(b))
    across = lambda v, a, b: F.greatest(F.abs(F.col(v) - F.col(a)), F.abs(F.col(v) - F.col(b)))
    met = placed.join(spread, ["gx", "gz"]).select(
        "point_id", "x", "z", "sx", "sz",
        F.hypot(outside("x", "left", "right"), outside("z", "low", "high")).alias("least"), F.hypot(across("x", "left", "right"), across("z", "low", "high")).alias("most"),
    ).where(F.col("least") <= reach)
    bound = met.groupBy("point_id").agg(F.min("most").alias("bound"))
    open_ = met.join(bound, "point_id").where(F.col("least") <= F.col("bound") * (1 + 1e-12)).select("point_id", "x", "z", "sx", "sz")
    distance = segment_distance(*[F.col(c) for c in ("x", "z", "x1", "z1", "x2", "z2")])
    return open_.join(gathered, ["sx", "sz"]).groupBy("point_id").agg(F.min(distance).alias("distance")).where(F.col("distance") <= reach)


def zone_band(points: DataFrame, vertices: DataFrame, olat: float, olon: float, scale: float, soft_km: float, hard_km: float, trim_km: float = 5.0) -> DataFrame:
    """``points(point_id, lat, lon)`` with band: inside, soft, hard, trim or outside the union of all zones, by exact distance.

    Only points that are inside no zone have their distance taken. point_id tells points apart.
    """
    inside = points_in_zones(points, vertices).select(F.col("point_id").alias("in_id")).distinct()
    flagged = points.join(inside, F.col("point_id") == F.col("in_id"), "left")
    placed = flagged.where("in_id is null").select("point_id", geo.block_xf("lon", olat, olon, scale).alias("x"), geo.block_zf("lat", olat, scale).alias("z"))
    blocks = [km * 1000.0 * scale for km in (soft_km, hard_km, hard_km + trim_km)]
    least = nearest(placed, _block_edges(vertices, olat, olon, scale), blocks[-1]).select(F.col("point_id").alias("d_id"), "distance")
    both = flagged.join(least, F.col("point_id") == F.col("d_id"), "left")
    band = F.when(F.col("in_id").isNotNull(), "inside")
    for name, limit in zip(("soft", "hard", "trim"), blocks, strict=True):
        band = band.when(F.col("distance") <= limit, name)
    return both.select(*points.columns, band.otherwise("outside").alias("band"))


# Priority and rule of a zone itself, the soft ring and the hard ring.
RULES = {"inside": (12, "allow"), "soft": (8, "allow"), "hard": (5, "deny")}


def zone_rule(banded: DataFrame) -> DataFrame:
    """The rule of the highest-priority ring that a point with ``band`` is in; the rings are nested; default deny."""
    nested = {"inside": ("inside", "soft", "hard"), "soft": ("soft", "hard"), "hard": ("hard",)}
    options = F.array().cast("array<struct<priority:int,rule:string>>")
    for band, ringed in nested.items():
        found = F.array(*[F.struct(F.lit(RULES[r][0]).alias("priority"), F.lit(RULES[r][1]).alias("rule")) for r in ringed])
        options = F.when(F.col("band") == band, found).otherwise(options)
    return banded.withColumn("rule", F.coalesce(F.array_max(options)["rule"], F.lit("deny")))


def shared_border(vertices: DataFrame, olat: float, olon: float, scale: float) -> DataFrame:
    """Vertices ``(zone_id, seq)`` of a zone within max(8, 800 * scale) blocks of another zone's border ``(other_id)``."""
    eps = max(8.0, 800.0 * scale)
    own = vertices.select(
        F.col("zone_id").alias("own_id"), "seq", geo.block_xf("lon", olat, olon, scale).alias("x"), geo.block_zf("lat", olat, scale).alias("z")
    )
    met = _near(own, _block_edges(vertices, olat, olon, scale), eps).where(F.col("own_id") != F.col("zone_id"))
    return met.select(F.col("own_id").alias("zone_id"), "seq", F.col("zone_id").alias("other_id")).distinct()


def ring_areas(vertices: DataFrame, *ring: str) -> DataFrame:
    around = edges(vertices, *ring)
    return around.groupBy(*ring).agg((F.abs(F.sum(F.col("lon") * F.col("lat2") - F.col("lon2") * F.col("lat"))) / 2).alias("area"))


def largest_part(vertices: DataFrame, zone: str, part: str) -> DataFrame:
    """Of each zone the part with the largest area, the smaller id of ones equal to 9 decimals."""
    areas = ring_areas(vertices, zone, part)
    return areas.groupBy(zone).agg(F.max_by(part, F.struct(F.round("area", 9), -F.col(part))).alias(part), F.max("area").alias("area"))


def zone_members(spec: DataFrame, countries: DataFrame) -> DataFrame:
    """``spec(zone, names)`` with the known countries of each zone; unknown names are ignored, a zone with none raises."""
    asked = spec.select("zone", F.explode("names").alias("name")).select("zone", F.lower(F.trim("name")).alias("key"))
    known = countries.select(F.lower(F.trim("name")).alias("key"), "country_id")
    found = asked.join(known, "key").select("zone", "country_id").distinct()
    lost = spec.select("zone").distinct().join(found, "zone", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no known country in zone {lost[0]['zone']}")
    return found


def realm_join(points: DataFrame, boxes: DataFrame, step: float = 5.0) -> DataFrame:
    """Points ``(point_id, lat, lon)`` with the code of the first box ``(code, south, north, west, east, priority)`` that holds them.

    Points and boxes meet on grid squares of ``step`` degrees. For the fixed boxes
    :func:`tessera.functions.geo.realm_of` needs no join.
    """
    square = lambda c: F.floor(F.col(c) / step)
    spread = boxes.withColumn("gx", F.explode(F.sequence(square("west"), square("east")))).withColumn("gy", F.explode(F.sequence(square("south"), square("north"))))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    met = points.withColumn("gx", square("lon")).withColumn("gy", square("lat")).join(spread, ["gx", "gy"]).where(inside)
    first = met.groupBy(F.col("point_id").alias("met_id")).agg(F.min_by("code", "priority").alias("code"))
    return points.join(first, F.col("point_id") == F.col("met_id"), "left").select("point_id", F.coalesce("code", F.lit(geo.NO_REALM)).alias("realm"))


def _distance(p: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    long2 = dx * dx + dy * dy
    t = 0.0 if long2 == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long2))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def reduce_line(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """Douglas-Peucker: without points closer than ``eps`` to the line that the kept ones make."""
    keep, open_ = {0, len(points) - 1}, [(0, len(points) - 1)]
    while open_:
        first, last = open_.pop()
        far, at = max(((_distance(points[k], points[first], points[last]), k) for k in range(first + 1, last)), key=lambda x: (x[0], -x[1]), default=(0.0, -1))
        if far > eps:
            keep.add(at)
            open_ += [(first, at), (at, last)]
    return [points[k] for k in sorted(keep)]


# The range that tolerances are searched in, in blocks, and the number of halvings.
LEAST_TOLERANCE, MOST_TOLERANCE, HALVINGS = 0.0, 200000.0, 28


def reduce_to(points: list[tuple[float, float]], target: int) -> list[tuple[float, float]]:
    """At most ``target`` points, with the least tolerance on a grid of 2 ** HALVINGS steps over its range that gives so few.

    A point stays while the tolerance is below all distances on its way down the splits, its worth.
    Splits are made in falling order of worth until one too many is there, which gives the tolerance.
    """
    if len(points) <= target:
        return points
    steps = 1 << HALVINGS
    width = (MOST_TOLERANCE - LEAST_TOLERANCE) / steps

    def split(first: int, last: int, most: float) -> tuple[float, int, int, int] | None:
        far, at = max(((_distance(points[k], points[first], points[last]), k) for k in range(first + 1, last)), key=lambda x: (x[0], -x[1]), default=(0.0, -1))
        return (-min(most, far), at, first, last) if far > LEAST_TOLERANCE else None

    open_ = [s for s in [split(0, len(points) - 1, math.inf)] if s]
    worth: dict[int, float] = {}
    while open_ and len(worth) < target - 1:
        w, at, first, last = heapq.heappop(open_)
        worth[at] = -w
        for s in (split(first, at, -w), split(at, last, -w)):
            if s:
                heapq.heappush(open_, s)
    tolerance = lambda k: LEAST_TOLERANCE + k * width
    least = 1
    if len(worth) == max(target - 1, 1):  # the ends stay; the last one has to go, and all of its worth
        goes = min(worth.values())
        least = min(steps, max(1, math.ceil((goes - LEAST_TOLERANCE) / width)))
        while least > 1 and tolerance(least - 1) >= goes:
            least -= 1
        while least < steps and tolerance(least) < goes:
            least += 1
    keep = {0, len(points) - 1, *(k for k, w in worth.items() if w > tolerance(least))}
    return [points[k] for k in sorted(keep)]


#: Rings are dealt to so many groups for each of the session's shuffle partitions.
GROUPS_PER_TASK = 4


def _per_ring(vertices: DataFrame, work) -> DataFrame:
    """``work`` on the points of each ring; Spark groups many rings by hash, as a group of its own for each ring costs more than the ring."""
    groups = GROUPS_PER_TASK * int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def apply(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["zone_id", "seq"])
        zone, lon, lat = (some[c].tolist() for c in ("zone_id", "lon", "lat"))
        out: list[tuple] = []
        start = 0
        for end in range(1, len(zone) + 1):
            if end == len(zone) or zone[end] != zone[start]:
                made = work(list(zip(lat[start:end], lon[start:end], strict=True)))
                out.extend((zone[start], k, p[1], p[0]) for k, p in enumerate(made))
                start = end
        return pd.DataFrame(out, columns=["zone_id", "seq", "lon", "lat"])

    dealt = vertices.withColumn("group_", F.pmod(F.xxhash64("zone_id"), F.lit(groups)))
    return dealt.groupBy("group_").applyInPandas(apply, "zone_id int, seq int, lon double, lat double")


def simplify(vertices: DataFrame, eps: float) -> DataFrame:
    """Rings without detail below ``eps`` degrees; rings of under 4 points, or that would keep under 3, as they were."""

    def work(points):
        if len(points) < 4 or eps <= 0:
            return points
        out = reduce_line(points, eps)
        return out if len(out) >= 3 else points

    return _per_ring(vertices, work)


def simplify_to(vertices: DataFrame, target: int) -> DataFrame:
    """Closed rings of about ``target`` whole-numbered points, without the closing one."""

    def work(points):
        out = [(float(round(a)), float(round(b))) for a, b in reduce_to(points, target)]
        return out[:-1] if len(out) > 1 and out[0] == out[-1] else out

    return _per_ring(vertices, work)
