"""facetlake: labelled rasters, detections and roof facets as Spark DataFrames."""
