"""barloom: ordered panel analytics written as ordinary PySpark DataFrame jobs."""
