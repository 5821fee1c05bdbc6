"""Tiled geodata on Spark: DataFrame operators for tiles, plans, rasters, zones and run reports."""
