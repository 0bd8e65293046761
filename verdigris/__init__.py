"""verdigris: opinion-catalog analytics expressed as Spark DataFrame jobs."""
