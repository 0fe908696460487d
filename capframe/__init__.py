"""Photo-caption analytics as Spark jobs."""
