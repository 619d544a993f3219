"""Entity-resolution analytics and corpus processing as PySpark DataFrame jobs."""
