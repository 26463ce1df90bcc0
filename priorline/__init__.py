"""Point-in-time forecast analytics as Spark jobs."""
