"""Coordinates as Column expressions: degrees, blocks, regions, cells and web-mercator tiles.

Block x grows east and z grows south of an origin; 512 blocks make a region; a cell is a square of
regions with index rz growing north. All functions take and return Columns (numbers are allowed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree of latitude, blocks per region and chunk, zoom limits, least file sizes.
METRES_PER_DEGREE = 111320.0
REGION, CHUNK = 512, 16
ZOOM_MIN, ZOOM_MAX = 11, 15
REGION_EPS = 1e-6
MEGABYTES_PER_REGION = 4
METRES_PER_PIXEL_Z15 = 40075016.0 / (256.0 * 32768.0)
# Realm boxes in order of precedence (code, lat_min, lat_max, lon_min, lon_max).
REALM_BOXES = [
    ("fl", 8.0, 31.0, -90.0, -60.0),
    ("ena", 8.0, 62.0, -100.0, -52.0),
    ("wna", 25.0, 72.0, -170.0, -100.0),
    ("sam", -56.0, 14.0, -82.0, -34.0),
    ("eur", 34.0, 72.0, -25.0, 40.0),
    ("afr", -36.0, 37.0, -19.0, 52.0),
    ("ind", -11.0, 29.0, 60.0, 155.0),
    ("asn", 5.0, 75.0, 40.0, 155.0),
    ("aus", -50.0, 0.0, 110.0, 180.0),
    ("aus", -50.0, 32.0, -180.0, -130.0),
]
NO_REALM = "vanilla-plus"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def metres_per_lon(lat) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.cos(F.radians(col(lat)))


def block_xf(lon, olat, olon, scale) -> Column:
    return (col(lon) - col(olon)) * metres_per_lon(olat) * col(scale)


def block_zf(lat, olat, scale) -> Column:
    return (col(olat) - col(lat)) * METRES_PER_DEGREE * col(scale)


def block_x(lon, olat, olon, scale) -> Column:
    return F.floor(block_xf(lon, olat, olon, scale))


def block_z(lat, olat, scale) -> Column:
    return F.floor(block_zf(lat, olat, scale))


def lon_of_block(x, olat, olon, scale) -> Column:
    return col(olon) + col(x) / (metres_per_lon(olat) * col(scale))


def lat_of_block(z, olat, scale) -> Column:
    return col(olat) - col(z) / (F.lit(METRES_PER_DEGREE) * col(scale))


def region_of(block) -> Column:
    return F.floor(col(block) / REGION)


def corner_region(block_float) -> Column:
    """Region of a cell's corner; a small epsilon keeps a corner on a region line in that region."""
    return F.floor(F.floor(col(block_float) + REGION_EPS) / REGION)


def cell_key(rx, rz, size) -> Column:
    return F.concat_ws(",", *[col(c).cast("bigint").cast("string") for c in (rx, rz, size)])


def key_part(key, k: int) -> Column:
    """The k-th of three integers of a cell key; null if the key is malformed."""
    parts = F.split(col(key), ",")
    whole = F.regexp_like(col(key), F.lit(r"^\s*[+-]?[0-9]+\s*,\s*[+-]?[0-9]+\s*,\s*[+-]?[0-9]+\s*$"))
    return F.when(whole, F.trim(F.get(parts, F.lit(k))).try_cast("int"))


def key_offset(key) -> Column:
    size = key_part(key, 2)
    return F.struct((key_part(key, 0) * size).alias("rx"), (-key_part(key, 1) * size).alias("rz"))


def valid_key(key, most: int = 16) -> Column:
    size = key_part(key, 2)
    return F.coalesce(key_part(key, 0).isNotNull() & key_part(key, 1).isNotNull() & size.between(1, most), F.lit(False))


def owned_rectangle(rx, rz, size) -> dict[str, Column]:
    """Inclusive region bounds that a cell owns."""
    rx, rz, size = col(rx), col(rz), col(size)
    return {"rx_min": rx * size, "rx_max": rx * size + size - 1, "rz_min": -rz * size - size, "rz_max": -rz * size - 1}


def cell_degrees(size, olat, scale) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that a cell spans."""
    metres = col(size) * REGION / col(scale)
    return metres / METRES_PER_DEGREE, metres / metres_per_lon(olat)


def cell_bbox(rx, rz, size, olat, olon, scale) -> dict[str, Column]:
    d_lat, d_lon = cell_degrees(size, olat, scale)
    south, west = col(olat) + col(rz) * d_lat, col(olon) + col(rx) * d_lon
    return {"south": south, "west": west, "north": south + d_lat, "east": west + d_lon}


def snap_region(lat, lon, scale, anchor_lat=0.0, anchor_lon=0.0) -> dict[str, Column]:
    """Nearest corner of the region grid; the longitude step is taken at the anchor's or the snapped latitude."""
    step = F.lit(REGION / METRES_PER_DEGREE) / col(scale)
    snapped = col(anchor_lat) + F.bround((col(lat) - col(anchor_lat)) / step) * step
    at = F.when(col(anchor_lat) != 0, col(anchor_lat)).otherwise(snapped)
    lon_step = F.lit(float(REGION)) / col(scale) / metres_per_lon(at)
    return {"lat": snapped, "lon": col(anchor_lon) + F.bround((col(lon) - col(anchor_lon)) / lon_step) * lon_step}


def snap_bbox(bbox: dict[str, Column], olat, olon, scale) -> dict[str, Column]:
    """Edges on the block grid of the origin; the box itself if that would leave nothing of it."""
    lat_step = 1.0 / col(scale) / METRES_PER_DEGREE
    lon_step = 1.0 / col(scale) / metres_per_lon(olat)
    out = {}
    for side, value in bbox.items():
        zero, step = (col(olat), lat_step) if side in ("south", "north") else (col(olon), lon_step)
        out[side] = zero + F.bround((col(value) - zero) / step) * step
    fits = (out["south"] < out["north"]) & (out["west"] < out["east"]) & (col(scale) > 0)
    return {side: F.when(fits, out[side]).otherwise(col(bbox[side])) for side in bbox}


def grow_bbox(bbox: dict[str, Column], lat_by, lon_by) -> dict[str, Column]:
    return {
        "south": col(bbox["south"]) - lat_by, "west": col(bbox["west"]) - lon_by,
        "north": col(bbox["north"]) + lat_by, "east": col(bbox["east"]) + lon_by,
    }


def expand_bbox(bbox: dict[str, Column], chunks: int, olat, olon, scale) -> dict[str, Column]:
    """``chunks`` more chunks on every side, snapped to the block grid."""
    blocks = col(float(max(chunks, 0) * CHUNK)) / col(scale)
    return snap_bbox(grow_bbox(bbox, blocks / METRES_PER_DEGREE, blocks / metres_per_lon(olat)), olat, olon, scale)


def generation_bbox(bbox: dict[str, Column], scale, seam_chunks: int = 8, margin_m: float = 256.0) -> dict[str, Column]:
    """What generating a selection reads: one region (edge cells reach to the region grid), the seam and a margin more on every side."""
    pad = F.when(col(scale) > 0, (REGION + seam_chunks * CHUNK) / col(scale)).otherwise(0.0) + margin_m
    mid = (col(bbox["south"]) + col(bbox["north"])) / 2
    return grow_bbox(bbox, pad / METRES_PER_DEGREE, pad / metres_per_lon(mid))


def margin_degrees(metres, lat) -> tuple[Column, Column]:
    """Degrees of latitude and longitude of a distance in metres; none or less is 0."""
    metres = F.greatest(col(metres), F.lit(0.0))
    return metres / METRES_PER_DEGREE, metres / metres_per_lon(lat)


def area_km2(bbox: dict[str, Column]) -> Column:
    mid = (col(bbox["south"]) + col(bbox["north"])) / 2
    high = (col(bbox["north"]) - col(bbox["south"])) * METRES_PER_DEGREE / 1000
    wide = (col(bbox["east"]) - col(bbox["west"])) * METRES_PER_DEGREE * F.cos(F.radians(mid)) / 1000
    return F.abs(high * wide)


def tiles_across(z: int | str | Column) -> Column:
    """Tiles in a row of zoom ``z``, a number or a column."""
    return F.lit(1 << z) if isinstance(z, int) else F.expr("shiftleft(1, {})".format(z)) if isinstance(z, str) else F.call_function("shiftleft", F.lit(1), z)


def tile_x(lon, z: int | str | Column) -> Column:
    n = tiles_across(z)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((col(lon) + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat, z: int | str | Column) -> Column:
    n = tiles_across(z)
    y = (F.lit(1.0) - F.asinh(F.tan(F.radians(col(lat)))) / F.pi()) / 2.0 * n
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(y))).cast("int")


def tile_bbox(x, y, z: int) -> dict[str, Column]:
    n = float(1 << z)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * v / n))))
    return {
        "south": lat(col(y) + 1), "west": col(x) / n * 360.0 - 180.0,
        "north": lat(col(y)), "east": (col(x) + 1) / n * 360.0 - 180.0,
    }


def recommended_zoom(scale, lat) -> Column:
    """Elevation zoom whose pixels match a block: 15 less the doublings, half-even, within limits; the largest where latitudes are past a pole."""
    pixel = F.lit(METRES_PER_PIXEL_Z15) * F.cos(F.radians(col(lat)))
    doublings = F.log2(F.greatest(1.0 / col(scale), F.lit(1e-6)) / F.greatest(pixel, F.lit(1e-6)))
    z = F.when(pixel >= 0, F.bround(F.lit(15.0) - doublings)).otherwise(F.lit(float(ZOOM_MAX)))
    return F.greatest(F.lit(ZOOM_MIN), F.least(F.lit(ZOOM_MAX), z)).cast("int")


def regions_in(size) -> Column:
    return col(size) * col(size)


def megabytes_of(regions) -> Column:
    """Expected megabytes of so many regions."""
    return col(regions) * MEGABYTES_PER_REGION


def tile_name(z, x, y) -> Column:
    return F.format_string("osm_g1_z%d_%d_%d.json", col(z).cast("int"), col(x).cast("int"), col(y).cast("int"))


def bbox_key(bbox: dict[str, Column], salt: str = "") -> Column:
    text = F.format_string("%.7f,%.7f,%.7f,%.7f|" + salt, *[col(bbox[s]) for s in ("south", "west", "north", "east")])
    return F.substring(F.sha1(text), 1, 16)


def region_id(bbox: dict[str, Column], name) -> Column:
    """First 16 hex digits of the SHA-1 of the box with 4 decimals and the lower-case name."""
    text = F.concat(
        F.format_string("%.4f,%.4f,%.4f,%.4f", *[col(bbox[s]) for s in ("south", "west", "north", "east")]), F.lit("|"), F.lower(F.trim(col(name)))
    )
    return F.substring(F.sha1(text), 1, 16)


def realm_of(lat, lon) -> Column:
    """Code of the first realm box that holds the point."""
    out = F.lit(NO_REALM)
    for code, south, north, west, east in reversed(REALM_BOXES):
        out = F.when(col(lat).between(south, north) & col(lon).between(west, east), code).otherwise(out)
    return out


#: Masks of the steps that spread 32 bits to every second of 64, as (shift, mask).
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def z_order(x: Column | str, y: Column | str) -> Column:
    """Place on the Z-order curve: the bits of x and y (from 0, under 31 bits) in turn, as a long."""

    def spread(v: Column | str) -> Column:
        out = (F.col(v) if isinstance(v, str) else v).cast("long")
        for shift, mask in SPREAD:
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def z_order_of(x: int, y: int) -> int:
    """:func:`z_order` of two numbers."""
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(31))
