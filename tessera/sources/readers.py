"""Scans: map tiles, catalogues, rasters, polygons, plans, trees, logs, region files, packs, worlds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.operators.coverage import LEAST_ELEVATION, LEAST_MAP

OSM_TILE = (
    "version double, generator string, elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,"
    "members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>, _corrupt_record string"
)
BBOX = "struct<south:double,west:double,north:double,east:double>"
PACK = f"region_id string, name string, bbox {BBOX}, zoom int, polygons array<array<array<double>>>, updated bigint, elevation struct<total:int,cached:int,pct:double>, osm struct<total:int,cached:int,pct:double>"
TREES = "realm string, default_community string, communities array<struct<name:string,habitat:string,density:int,species:array<struct<name:string,w1:array<string>,w2:array<string>,w3:array<string>>>>>"
WORLD = "world string, origin struct<lat:double,lon:double,locked:boolean>, settings map<string,string>, merged_cells array<string>"
COUNTRIES = "features array<struct<properties:struct<name:string>,geometry:string>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def scan_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tile files as nodes, ways and relations; corrupt files are skipped."""
    elements = _json(spark, path, OSM_TILE).where("_corrupt_record is null").select(F.explode("elements").alias("e")).select("e.*")
    of = lambda kind, *columns: elements.where(F.col("type") == kind).select("id", *columns, "tags")
    return of("node", "lon", "lat"), of("way", F.col("nodes").alias("refs")), of("relation", "members")


def _catalogue(spark: SparkSession, path: str, pattern: str, names: list[str], least: int) -> DataFrame:
    """Files by name and length only; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = [F.regexp_extract("path", pattern, k + 1).cast("int").alias(n) for k, n in enumerate(names)]
    return files.where(F.col("path").rlike(pattern) & (F.col("length") >= least)).select(*parts, "length", "path")


def tile_catalog(spark: SparkSession, path: str, zoom: int | None = None) -> DataFrame:
    """Elevation tiles ``z{z}_x{x}_y{y}.png`` of 67 bytes or more."""
    tiles = _catalogue(spark, path, r"z(\d+)_x(\d+)_y(\d+)\.png$", ["z", "x", "y"], LEAST_ELEVATION)
    return tiles if zoom is None else tiles.where(F.col("z") == zoom)


def osm_catalog(spark: SparkSession, path: str, zoom: int = 11) -> DataFrame:
    """Map tiles ``osm_g1_z{z}_{x}_{y}.json`` of 12 bytes or more."""
    return _catalogue(spark, path, r"osm_g1_z(\d+)_(\d+)_(\d+)\.json$", ["z", "x", "y"], LEAST_MAP).where(F.col("z") == zoom)


def scan_raster(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """Elevation images as heights row by row; the image source gives bytes as blue, green, red.

    With ``stride`` k only every k-th pixel of every k-th row becomes a height, and width and height
    are those of the sample: what :func:`tessera.operators.raster.strided` takes of whole tiles,
    without the work for the others.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    named = [F.regexp_extract("origin", r"z(\d+)_x(\d+)_y(\d+)\.png", k).cast("int").alias(n) for k, n in ((1, "z"), (2, "x"), (3, "y"))]
    byte = lambda i: F.conv(F.hex(F.substring(F.col("data"), i + 1, F.lit(1))), 16, 10).cast("int")
    across, down = ((F.ceil(F.col(c) / stride)).cast("int") for c in ("width", "height"))
    sample = F.sequence(F.lit(0), across * down - 1)
    channels = F.col("nChannels")

    def height(k: Column) -> Column:
        at = (F.floor(k / across).cast("int") * stride * F.col("width") + k % across * stride) * channels
        return raster.decode(byte(at + 2), byte(at + 1), byte(at))

    return images.select(*named, F.transform(sample, height).alias("h"), across.alias("width"), down.alias("height"))


def scan_countries(spark: SparkSession, path: str) -> DataFrame:
    """Polygon vertices ``(name, part, ring, seq, lon, lat)``, names in lower case; single and multi polygons alike."""
    features = _json(spark, path, COUNTRIES).select(F.explode("features").alias("f"))
    kind = F.get_json_object("f.geometry", "$.type")
    single = F.array(F.from_json("f.geometry", "coordinates array<array<array<double>>>")["coordinates"])
    multi = F.from_json("f.geometry", "coordinates array<array<array<array<double>>>>")["coordinates"]
    shapes = features.select(F.lower("f.properties.name").alias("name"), F.when(kind == "MultiPolygon", multi).otherwise(single).alias("parts"))
    parts = shapes.select("name", F.posexplode_outer("parts").alias("part", "rings"))  # outer: the shapes are parsed once
    rings = parts.select("name", "part", F.posexplode_outer("rings").alias("ring", "points"))
    points = rings.select("name", "part", "ring", F.posexplode_outer("points").alias("seq", "p")).where("p is not null")
    return points.select("name", "part", "ring", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def country_names(countries: DataFrame) -> DataFrame:
    return countries.select("name").distinct().orderBy("name")


def scan_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan object ``{cell key: status}`` as rows; malformed keys are left out."""
    from tessera.functions import geo

    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("cell_key", "status"))
    parts = [geo.key_part("cell_key", k).alias(n) for k, n in enumerate(("rx", "rz", "size"))]
    return rows.where(geo.valid_key("cell_key", 64)).select("cell_key", *parts, "status")


def scan_trees(spark: SparkSession, path: str) -> DataFrame:
    """Tree catalogues as ``(realm, community, habitat, species, tier, model)``."""
    packs = _json(spark, path, TREES)
    communities = packs.select("realm", F.explode("communities").alias("c"))
    species = communities.select("realm", F.col("c.name").alias("community"), "c.habitat", F.explode("c.species").alias("s"))
    tiers = F.array(*[F.struct(F.lit(w).alias("tier"), F.col(f"s.{w}").alias("models")) for w in ("w1", "w2", "w3")])
    tiered = species.select("realm", "community", "habitat", F.col("s.name").alias("species"), F.explode(tiers).alias("t"))
    return tiered.select("realm", "community", "habitat", "species", F.col("t.tier").alias("tier"), F.explode("t.models").alias("model"))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with ``(path, start)``, as a task reads them, with line_no: it rises along a file, however it is split.

    A block's lines are counted from its first byte, and none of them is shorter than a byte.
    """
    block, n = None, 0
    for batch in batches:
        out = []
        for at in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
            block, n = at, n + 1 if at == block else 0
            out.append(at[1] + n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "line_no"])


def log_key(path: str = "path") -> Column:
    """Cell key of a log called, or in a folder called, ``cell-rx_rz_size.log``; else empty."""
    return F.translate(F.regexp_extract(path, r"cell-(-?\d+_-?\d+_\d+)\.log", 1), "_", ",")


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of cell logs ``cell-rx_rz_size.log`` as ``(cell_key, line_no, line)``; line_no rises along a log. No log is held whole."""
    logs = spark.read.option("recursiveFileLookup", True).text(path)
    lines = logs.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    shown = lines.where(log_key() != "").mapInArrow(numbered, "line string, path string, start long, line_no long")
    return shown.select(log_key().alias("cell_key"), "line_no", "line")


def scan_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region files ``<sub>/r.X.Z.mca`` as ``(sub, reg_x, reg_z, length)``; their content isn't read."""
    pattern = r"/(\w+)/r\.(-?\d+)\.(-?\d+)\.mca$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mca").load(path).select("path", "length")
    part = lambda k: F.regexp_extract("path", pattern, k)
    return files.where(F.col("path").rlike(pattern)).select(part(1).alias("sub"), part(2).cast("int").alias("reg_x"), part(3).cast("int").alias("reg_z"), "length")


def list_packs(spark: SparkSession, path: str, cached: DataFrame) -> DataFrame:
    """Pack manifests with their coverage computed again from ``cached(z, x, y)``."""
    from tessera.operators import coverage, generate

    packs = _json(spark, path, PACK).select("region_id", "name", "zoom", "bbox.*")
    tiles = generate.tiles_for_bbox(packs, "zoom")
    return packs.join(coverage.coverage(tiles, cached, "region_id"), "region_id", "left")


def read_world_meta(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, WORLD)


def scan_sources(catalogue: DataFrame) -> DataFrame:
    """Source files ``(path, length, south, west, north, east)``, one row per path, the largest of repeated ones."""
    rest = [c for c in catalogue.columns if c != "path"]
    return catalogue.groupBy("path").agg(F.max_by(F.struct(*rest), "length").alias("r")).select("path", "r.*")
