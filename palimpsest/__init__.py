"""Document retrieval and corpus analytics on PySpark."""
