"""Scene retrieval, raster change analytics and corpus preparation as PySpark jobs."""
