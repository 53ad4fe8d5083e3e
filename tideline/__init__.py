"""Point-in-time panel analytics as Spark DataFrame jobs."""
