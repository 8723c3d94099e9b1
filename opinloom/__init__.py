"""opinloom: review analytics expressed as Spark DataFrame jobs."""
