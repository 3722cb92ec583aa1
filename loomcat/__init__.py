"""loomcat: catalog search, review analytics and training-data operators on PySpark."""
