"""placewise: geospatial preference scoring expressed as PySpark DataFrame jobs."""
