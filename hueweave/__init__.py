"""hueweave: raster analytics and corpus preparation over Spark DataFrames."""
