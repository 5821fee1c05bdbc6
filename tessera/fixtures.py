"""Geodata views derived from the driver's tables, for queries and their SQL twins.

The text of each view runs in Spark SQL and DuckDB alike, but for ``fx_pixel``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "fx_node": """
        SELECT p_partkey AS id, CAST(24 AS DOUBLE) + ((p_partkey * 7919) % 20000) / CAST(10000 AS DOUBLE) AS lon, CAST(45 AS DOUBLE) + ((p_partkey * 104729) %
        20000) / CAST(10000 AS DOUBLE) AS lat, p_brand AS tag_name FROM part
    """,
    "fx_node_tile": """
        SELECT id, lon, lat, CAST(greatest(0, least(2047, floor((lon + 180.0) / 360.0 * 2048))) AS INT) AS x, CAST(greatest(0, least(2047, floor((1.0 -
        asinh(tan(radians(lat))) / pi()) / 2.0 * 2048))) AS INT) AS y FROM fx_node
    """,
    "fx_way_ref": """
        SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS
        seq, l_partkey AS ref FROM lineitem
    """,
    "fx_rel_member": """
        SELECT o_custkey AS rel_id, 'way' AS member_type, o_orderkey AS ref, o_orderpriority AS role FROM orders
    """,
    "fx_raster": """
        SELECT vec_id, 13 AS z, CAST(vec_id % 25 AS INT) AS x, CAST(floor(vec_id / 25.0) AS INT) AS y, label, CASE WHEN vec_id % 7 = 0 THEN TRUE ELSE FALSE
        END AS is_hole, embedding FROM embeddings
    """,
    "fx_cell_event": """
        SELECT event_id, ts, user_id, concat(CAST(user_id % 12 - 6 AS VARCHAR(12)), ',', CAST(CAST(floor(user_id / 12.0) AS BIGINT) - 6 AS VARCHAR(12)), ',4')
        AS cell_key, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'started' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'merged' ELSE
        'failed' END AS status, CAST(event_id % 8 AS INT) AS worker, value AS duration_s FROM events
    """,
    "fx_log_line": """
        SELECT event_id AS line_no, user_id % 40 AS cell_id, CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'ERROR: out of memory while saving' WHEN 1 THEN 'HTTP
        429 Too Many Requests' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'thread main panicked at src' WHEN 4 THEN 'Fetching tile x=3 y=9' WHEN 5 THEN
        'Failed to read ESA tile 12' WHEN 6 THEN 'tile z13 is too small. Re-downloading' WHEN 7 THEN concat('tile ', CAST(event_id % 97 AS VARCHAR(12)),
        '/96') WHEN 8 THEN 'saving region' ELSE 'ok' END AS line FROM events
    """,
    "fx_ring_vertex": """
        SELECT r.r_regionkey AS zone_id, r.r_name AS zone, CAST(rn AS INT) AS seq, round(22.0 + 2.0 * r.r_regionkey + 1.2 * cos(2.0 * pi() * rn / 5.0), 6) AS
        lon, round(45.0 + 1.2 * sin(2.0 * pi() * rn / 5.0), 6) AS lat FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY
        n_nationkey) - 1 AS rn FROM nation) n JOIN region r ON r.r_regionkey = n.n_regionkey
    """,
    "fx_point": """
        SELECT c_custkey AS point_id, CAST(20 AS DOUBLE) + ((c_custkey * 7919) % 120000) / CAST(10000 AS DOUBLE) AS lon, CAST(43.5 AS DOUBLE) + ((c_custkey *
        104729) % 30000) / CAST(10000 AS DOUBLE) AS lat, c_mktsegment AS kind FROM customer
    """,
    "fx_tile_level": """
        SELECT DISTINCT z, x, y, has_data FROM ( SELECT 13 AS z, x, y, NOT is_hole AS has_data FROM fx_raster UNION ALL SELECT 12, CAST(floor(x / 2.0) AS
        INT), CAST(floor(y / 2.0) AS INT), (CAST(floor(x / 2.0) AS INT) * 7 + CAST(floor(y / 2.0) AS INT) * 3) % 4 <> 0 FROM fx_raster UNION ALL SELECT 11,
        CAST(floor(x / 4.0) AS INT), CAST(floor(y / 4.0) AS INT), (CAST(floor(x / 4.0) AS INT) + CAST(floor(y / 4.0) AS INT)) % 3 <> 0 FROM fx_raster) u
    """,
    "fx_cached_tile": """
        SELECT DISTINCT 11 AS z, x, y FROM fx_node_tile WHERE (x + y) % 3 <> 0
    """,
    "fx_plan": """
        SELECT cell_key, CAST(split_part(cell_key, ',', 1) AS INT) AS rx, CAST(split_part(cell_key, ',', 2) AS INT) AS rz, 4 AS size, status FROM ( SELECT
        cell_key, status, row_number() OVER (PARTITION BY cell_key ORDER BY ts DESC, event_id DESC) AS rn FROM fx_cell_event) t WHERE rn = 1
    """,
    "fx_region_file": """
        SELECT p.cell_key, p.rx * 4 + a.i AS reg_x, -p.rz * 4 - 4 + b.i AS reg_z FROM fx_plan p CROSS JOIN (VALUES (-1), (0), (1), (2), (3), (4)) AS a(i)
        CROSS JOIN (VALUES (-1), (0), (1), (2), (3), (4)) AS b(i) WHERE p.status = 'merged' AND (p.rx * 31 + p.rz * 17 + a.i * 5 + b.i) % 37 <> 0
    """,
    "fx_position": """
        SELECT event_id, ts, user_id AS mover, CAST(21 AS DOUBLE) + ((event_id * 7919) % 100000) / CAST(10000 AS DOUBLE) AS lon, CAST(44 AS DOUBLE) +
        ((event_id * 104729) % 20000) / CAST(10000 AS DOUBLE) AS lat FROM events
    """,
    "fx_parent_pixel": """
        SELECT t.z, t.x, t.y, p.px, p.py, p.h FROM fx_tile_level t JOIN fx_pixel p ON p.vec_id = ((t.x * 31 + t.y * 17) % 70) * 7 + 1 WHERE t.z < 13 AND
        t.has_data
    """,
    "fx_pixel": """
        SELECT vec_id, z, x, y, CAST(pos % 8 AS INT) AS px, CAST(floor(pos / 8.0) AS INT) AS py, CASE WHEN is_hole THEN CAST(-32768 AS DOUBLE) ELSE
        round(CAST(e AS DOUBLE) * 1000, 3) END AS h FROM fx_raster LATERAL VIEW posexplode(embedding) p AS pos, e
    """,
    "fx_zone_vertex": """
        SELECT CAST(s_suppkey AS INT) AS zone_id, concat('zone', CAST(s_suppkey AS VARCHAR(12))) AS zone, i AS seq,
        round(21.0 + (s_suppkey * 7919 % 1000) / 100.0 + (0.05 + s_suppkey % 5 * 0.05) * cos(2.0 * pi() * i / 6.0), 6) AS lon,
        round(44.0 + (s_suppkey * 104729 % 200) / 100.0 + (0.05 + s_suppkey % 5 * 0.05) * sin(2.0 * pi() * i / 6.0), 6) AS lat
        FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS c(i)
    """,
    "fx_cell_box": """
        SELECT rx, rz, size, status, cell_key,
        45 + rz * dl AS south, 45 + (rz + 1) * dl AS north, 25 + rx * dn AS west, 25 + (rx + 1) * dn AS east FROM (
        SELECT *, size * 512 / CAST(0.3 AS DOUBLE) / CAST(111320 AS DOUBLE) AS dl,
        size * 512 / CAST(0.3 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians(CAST(45 AS DOUBLE)))) AS dn FROM fx_plan) p
    """,
}
DUCKDB_VIEWS = {
    "fx_pixel": """
        SELECT vec_id, z, x, y, CAST(pos % 8 AS INT) AS px, CAST(floor(pos / 8.0) AS INT) AS py, CASE WHEN is_hole THEN CAST(-32768 AS DOUBLE) ELSE
        round(CAST(e AS DOUBLE) * 1000, 3) END AS h FROM (SELECT *, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM fx_raster) t
    """,
}


def needed(sql: str, views: dict[str, str]) -> list[str]:
    """Names of the views that ``sql`` needs, each after those it needs itself."""
    out: list[str] = []
    for name in dict.fromkeys(re.findall(r"fx_\w+", sql)):
        out += [n for n in [*needed(views[name], views), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a driver table by its own name."""
    if not name.startswith("fx_"):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for table in TABLES:
        if any(re.search(rf"\b{table}\b", VIEWS[n]) for n in [*needed(VIEWS[name], VIEWS), name]):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for other in needed(VIEWS[name], VIEWS):
        spark.sql(VIEWS[other]).createOrReplaceTempView(other)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views it needs as leading table expressions."""
    views = VIEWS | DUCKDB_VIEWS
    names = needed(sql, views)
    if not names:
        return sql
    heads = ", ".join(f"{n} AS ({views[n]})" for n in names)
    body = re.sub(r"^\s*WITH\s+", ", ", sql) if re.match(r"\s*WITH\s", sql) else " " + sql
    return f"WITH {heads}{body}"
