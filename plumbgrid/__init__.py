"""Located tables and streams on Spark: points, zones, grids and tracks as plain columns."""
