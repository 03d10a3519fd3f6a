"""DataFrame operators: joins, cleaning, spatial, raster, sampling, summaries, statistics."""
