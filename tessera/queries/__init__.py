"""All queries of the geodata operators, with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.fixtures import with_views
from tessera.queries import composed, coords, osm, planning, rasters, runs, streams

MODULES = (coords, osm, planning, rasters, runs, streams, composed)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: with_views(sql) for module in MODULES for name, sql in module.SQL.items()}
