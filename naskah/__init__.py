"""Document-integrity analytics as PySpark DataFrame jobs."""
