"""fieldloom: raster zoning, coverage planning and table analytics as Spark DataFrame operators."""
